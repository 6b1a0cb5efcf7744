"""Where queries and their SQL are kept."""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    """Register a query (spark, folder of tables) and the SQL with the same rows."""

    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep
