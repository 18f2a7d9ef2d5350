"""A PySpark-native analytics engine for collections of linked text notes."""
