"""Recorded sequences of actions: signatures, and what differs between two of them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clicks are told apart by a grid of so many pixels, and delays by so many seconds.
GRID, LATE = 50, 0.5
ACTION = "struct<action:string,url:string,selector:string,text:string,label:string,direction:string,amount:long,x:double,y:double,delay:double>"


def signature(a: Column) -> Column:
    """What an action does, so that small moves and long labels don't matter."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    near = lambda c: (F.bround(F.coalesce(c, F.lit(0.0)) / GRID, 0) * GRID).cast("long").cast("string")
    start = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    click = F.concat(F.lit("click:("), near(a["x"]), F.lit(","), near(a["y"]), F.lit("):"), start(a["selector"], 30), F.lit(":"), start(a["label"], 20))
    kind = a["action"]
    return (
        F.when(kind == "navigate", F.concat(F.lit("navigate:"), text(a["url"])))
        .when(kind == "click", click)
        .when(kind == "scroll", F.concat(F.lit("scroll:"), text(a["direction"]), F.lit(":"), text(a["amount"])))
        .when(kind == "type", F.concat(F.lit("type:"), text(a["text"])))
        .otherwise(kind)
    )


def difference(a: list[tuple], b: list[tuple]) -> dict:
    """Alignment of two sequences of (signature, delay, url): places that match, were added, removed, replaced or are late."""
    blocks = difflib.SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b])
    same, added, removed, replaced, late = 0, [], [], [], []
    for kind, i, i_end, j, j_end in blocks.get_opcodes():
        both = min(i_end - i, j_end - j)
        if kind == "equal":
            same += both
            late += [i + k for k in range(both) if abs((a[i + k][1] or 0) - (b[j + k][1] or 0)) > LATE]
        else:
            replaced += [i + k for k in range(both)]
            removed += range(i + both, i_end)
            added += range(j + both, j_end)
    gone, come = ({x[2] for x in s if x[2]} for s in (a, b))
    time = sum(x[1] or 0 for x in b) - sum(x[1] or 0 for x in a)
    return {"matching": same, "added": added, "removed": removed, "replaced": replaced, "timing": late, "urls_added": sorted(come - gone), "urls_removed": sorted(gone - come), "timing_diff": round(time, 6), "similarity": blocks.ratio()}


DIFFERENCE = "matching long, added array<int>, removed array<int>, replaced array<int>, timing array<int>, urls_added array<string>, urls_removed array<string>, timing_diff double, similarity double"


def compared(a: Column, b: Column) -> Column:
    """Struct of difference() of two arrays of actions; alignment is sequential, so this is an Arrow UDF over pairs of short sequences."""

    @F.pandas_udf(f"struct<{DIFFERENCE.replace(' long', ':long').replace(' array', ':array').replace(' double', ':double')}>")
    def align(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [difference([tuple(e.values()) for e in p], [tuple(e.values()) for e in q]) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DIFFERENCE.split(", ")])

    said = lambda c: F.transform(c, lambda e: F.struct(signature(e).alias("signature"), e["delay"].alias("delay"), F.when(e["action"] == "navigate", e["url"]).alias("url")))
    return align(said(a), said(b))
