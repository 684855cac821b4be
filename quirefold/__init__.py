"""quirefold: a PySpark-native engine for turning extracted books into lines, blocks, sentences, reading units and corpus reports."""
