"""glyphframe: a PySpark-native analytics engine for collections of line drawings and the records that describe them."""
