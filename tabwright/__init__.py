"""tabwright: tabular analytics operators written for PySpark.

Every operator takes DataFrames and returns DataFrames; nothing here collects
table rows to the driver.
"""
