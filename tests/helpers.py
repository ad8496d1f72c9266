"""Comparison helpers shared by the oracle tests."""

import numpy as np
import pandas as pd


def normalise(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = pd.to_datetime(df[c]).dt.tz_localize(None).astype("datetime64[us]")
    return df


def assert_frames_match(a: pd.DataFrame, b: pd.DataFrame) -> None:
    a, b = normalise(a), normalise(b)
    assert list(a.columns) == list(b.columns), (list(a.columns), list(b.columns))
    assert len(a) == len(b), (len(a), len(b))
    a = a.sort_values(list(a.columns), na_position="first", kind="mergesort").reset_index(drop=True)
    b = b.sort_values(list(b.columns), na_position="first", kind="mergesort").reset_index(drop=True)
    for c in a.columns:
        x, y = a[c], b[c]
        if pd.api.types.is_float_dtype(x) or pd.api.types.is_float_dtype(y):
            assert np.allclose(x.astype(float), y.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            xs = x.astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan"})
            ys = y.astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan"})
            assert (xs == ys).all(), (c, xs[xs != ys].head(3).tolist(), ys[xs != ys].head(3).tolist())
