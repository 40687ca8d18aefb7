from keelson.sources.tables import table

__all__ = ["table"]
