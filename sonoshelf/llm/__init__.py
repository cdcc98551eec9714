"""Operations for preparing training text: one module per operation, queries in ``entry``."""
