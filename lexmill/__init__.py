"""lexmill: a PySpark-native engine for document corpora.

Sub-packages: ``sources`` (readers and writers), ``functions`` (Column to
Column), ``operators`` (DataFrame to DataFrame), ``plans`` (registered
queries), ``streaming`` (incremental jobs).
"""
