"""usagelens: batch and streaming analytics over chat-request traffic, on Spark.

Every operator takes DataFrames and parameters and returns a DataFrame.
"""
