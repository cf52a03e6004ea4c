"""Lodestrata: a PySpark-native engine for collections of files and documents."""
