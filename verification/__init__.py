"""Queries over the given tables, one per operator, and the SQL they must agree with."""


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib

    for module in ("scalars", "personal_data", "injections", "reports", "decisions", "streams", "stores"):
        importlib.import_module(f".{module}", __name__)
