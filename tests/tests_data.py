from test_parse import EU, RECEIPT

__all__ = ["EU", "RECEIPT"]
