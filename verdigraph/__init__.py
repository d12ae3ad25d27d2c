"""verdigraph: a Spark-native engine that scores natural-language-to-graph-query answers.

Every operator takes DataFrames and returns a DataFrame; nothing runs until the caller acts on the result.
"""
