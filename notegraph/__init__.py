"""notegraph: a PySpark-native engine for collections of linked documents."""
