"""Shared by tests."""


def rows_of(frame):
    """Rows of a pandas frame, columns by name, floats rounded, sorted."""
    import pandas as pd

    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 5)
        return tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)
