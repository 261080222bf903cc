"""A PySpark-native engine for titles made of ordered pages that hold positioned text."""
