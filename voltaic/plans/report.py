"""The report surface: figures as JSON from small aggregates, page fragments, the release gate."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import centred_mid, clip_range, spearman
from ..functions.time import local

GATE = "<!-- release-gate -->"
LEAST_N = 8


def _columns(df: DataFrame, *order: str) -> dict[str, list]:
    """An aggregate of some hundred rows as lists."""
    rows = df.orderBy(*order).collect()
    return {c: [r[c] for r in rows] for c in df.columns}


def figure(div: str, traces: list[dict], **layout) -> str:
    """A figure's JSON, the same for the same data."""
    return json.dumps({"id": div, "data": traces, "layout": layout}, sort_keys=True, default=str, allow_nan=False)


def value_page(values: DataFrame, plans: list[str]) -> dict:
    """Average day and daily line of prices and wedges, by the local clock, and the table by period of each plan."""
    from ..operators.value import period_table

    clock = local(F.col("timestamp_utc"))
    means = [F.avg(c).alias(c) for c in ("energy_price", *[f"{p}_wedge" for p in plans])]
    by_hour = _columns(values.groupBy(F.hour(clock).alias("hour")).agg(*means), "hour")
    by_day = _columns(values.groupBy(clock.cast("date").alias("day")).agg(*means), "day")
    lines = lambda x, t: [{"type": "scatter", "name": c, "x": t[x], "y": t[c]} for c in t if c != x]
    return {"average_day": figure("average-day", lines("hour", by_hour)), "daily": figure("daily", lines("day", by_day)), "periods": {p: _columns(period_table(values, p), "period") for p in plans}}


def map_layer(areas: DataFrame, metric: str, key: str = "licence_no", name: str = "utility_name") -> str:
    """A choropleth layer: values clipped to their 2nd and 98th percentile, areas of several zones or without a report in grey."""
    shown = areas.where(F.col("reported") & ~F.coalesce("multi_zone", F.lit(False)) & F.col(metric).isNotNull())
    lo, hi = clip_range(shown, metric).first()
    own = _columns(shown.select(key, name, metric), key)
    grey = _columns(areas.select(key, name).join(shown.select(key), key, "left_anti"), key)
    own_trace = {"type": "choroplethmap", "locations": own[key], "z": own[metric], "text": own[name], "zmin": lo, "zmax": hi, "zmid": centred_mid(lo, hi)}
    return figure(f"map-{metric}", [own_trace, {"type": "choroplethmap", "name": "not reported", "locations": grey[key], "text": grey[name]}])


def node_layer(nodes: DataFrame, metric: str) -> str:
    """Nodes(node, lon, lat) with a value, clipped like areas."""
    shown = nodes.where(F.col(metric).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    lo, hi = clip_range(shown, metric).first()
    own = _columns(shown.select("node", "lon", "lat", metric), "node")
    return figure(f"nodes-{metric}", [{"type": "scattermap", "lon": own["lon"], "lat": own["lat"], "text": own["node"], "color": own[metric], "cmin": lo, "cmax": hi, "cmid": centred_mid(lo, hi)}])


def correlation_page(signal: DataFrame, adoption: DataFrame, metric: str = "capacity_per_1000_customers_mw") -> dict | None:
    """Approved areas as filled and hollow (heterogeneous) markers; rho of the filled ones if there are eight; None for no area."""
    both = signal.where("owner_status = 'approved'").join(adoption.where(F.col("reported") & F.col(metric).isNotNull()).select("licence_no", metric), "licence_no")
    both = both.select("licence_no", "utility_name", "mean_premium", metric, F.when(F.col("heterogeneous"), "hollow").otherwise("filled").alias("marker"))
    rows = _columns(both, "licence_no")
    if not rows["licence_no"]:
        return None
    rho, n = spearman(both.where("marker = 'filled'"), "mean_premium", metric).first()
    text = f"rho = {rho:.2f} (n = {n})" if n >= LEAST_N and rho is not None else ""
    return {"figure": figure("adoption-signal", [{"type": "scatter", "mode": "markers", "x": rows["mean_premium"], "y": rows[metric], "text": rows["utility_name"], "symbol": rows["marker"]}]), "n": n, "hollow": rows["marker"].count("hollow"), "rho": text}


def markdown(text: str) -> str:
    """Headings, lists, bold, code, links and paragraphs; everything is escaped first."""
    out, items = [], []

    def inline(s: str) -> str:
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        s = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", s)
        return re.sub(r"\[([^\]]+)\]\((https?://[^)\s]+)\)", r'<a href="\2">\1</a>', s)

    def close() -> None:
        if items:
            out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            items.clear()

    for block in re.split(r"\n\s*\n", html.escape(text.strip(), quote=False)):
        for line in [block] if not re.match(r"\s*(#|- )", block) else block.split("\n"):
            if m := re.match(r"(#{1,6}) (.*)", line):
                close()
                out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            elif m := re.match(r"\s*- (.*)", line):
                items.append(inline(m[1]))
            else:
                close()
                out.append(f"<p>{inline(' '.join(line.split()))}</p>") if line.strip() else None
        close()
    return "\n".join(out)


def page(title: str, *parts: str) -> str:
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head>\n<body>\n' + "\n".join(parts) + "\n</body></html>\n"


def gated(doc: str, approved: bool) -> str:
    """The page with a notice unless its release is approved; applying it again changes nothing."""
    doc = re.sub(rf"{GATE}.*?{GATE}\n?", "", doc, flags=re.S)
    return doc if approved else doc.replace("<body>\n", f"<body>\n{GATE}<p>Draft: not for release.</p>{GATE}\n", 1)


def short_time(instant) -> str:
    return instant.strftime("%Y-%m-%d %H:%M") if instant else "unknown"


def status(values: DataFrame, assigned: DataFrame, signal: DataFrame, adoption: DataFrame) -> dict:
    """The status panel's facts, each from one aggregate: window and coverage, partial and missing days, zoned share, counts by method and status."""
    from ..functions.stats import coverage_gaps, history_length
    from ..operators.value import summary

    window = summary(values).first().asDict()
    gaps = _columns(coverage_gaps(values, "timestamp_utc"), "day")
    nodes = assigned.agg(F.count("*").alias("nodes"), F.count("zone").alias("zoned")).first()
    counts = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().orderBy(c).collect()}
    return {
        "window": window, "history": history_length(window["hours"], window["window_start"].date()) if window["hours"] else None, "gaps": gaps,
        "zoned_share": nodes["zoned"] / nodes["nodes"] if nodes["nodes"] else None, "methods": counts(signal, "method"), "statuses": counts(signal, "owner_status"),
        "reported": adoption.agg(F.count_if("reported")).first()[0], "heterogeneous": signal.agg(F.count_if("heterogeneous")).first()[0],
    }
