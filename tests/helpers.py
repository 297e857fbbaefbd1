"""What tests share."""

DATA = "/root/testdata/sf0.001"

def _plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__.startswith("bool"):
        return str(bool(v))
    if isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return f"{float(v):.9g}"


def table_of(df):
    """The rows of a pandas frame in a form that compares: columns by name, values as text."""
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(_plain(v) for v in row) for row in df.astype(object).where(df.notna(), None).values.tolist())
