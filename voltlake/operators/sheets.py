"""Operators between table cells and claims: canonical rows, shading thresholds, glyph runs, column roles.

Ordered per-page algorithms run whole pages in ``applyInPandas``; a page is a bounded group. The rest is columns.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADERS = ("feeder name", "feeder", "name of feeder")


def canonical_cells(cells: Column, meta: Column) -> Column:
    """A row of 5 + 24 cells: division, area, feeder, load, marker, hours. Layouts with four metadata columns have
    no load; short rows are padded. The cells are computed once, as the variable of a lambda."""

    def row(c: Column) -> Column:
        full = F.transform(F.concat(c, F.array_repeat(F.lit(""), F.greatest(F.lit(0), meta + 24 - F.size(c)))), lambda x: F.coalesce(x, F.lit("")))
        four = F.concat(F.slice(full, 1, 3), F.array(F.lit("")), F.slice(full, 4, 1))
        return F.concat(F.when(meta >= 5, F.slice(full, 1, 5)).otherwise(four), F.slice(full, meta + 1, F.lit(24)))

    return F.get(F.transform(F.array(cells), row), F.lit(0))


def drop_reason(row: Column) -> Column:
    """Why a canonical row is no claim: a repeated header, no feeder or division, no mark; else null. Any non-empty
    hour cell is a mark, also ``0``."""
    feeder, division = F.trim(F.get(row, 2)), F.trim(F.get(row, 0))
    marks = F.exists(F.slice(row, 6, 24), lambda c: F.trim(c) != "")
    return F.when(F.lower(feeder).isin(*HEADERS), "header").when((feeder == "") | (division == ""), "no feeder").when(~marks, "no marks")


def otsu(cells: DataFrame, keys: list[str], value: str, spread: float = 18.0) -> DataFrame:
    """Per key the darkness threshold that separates best, over a histogram of 256 bins, and whether the values
    spread enough to be used."""
    h = cells.groupBy(*keys, F.least(F.lit(255), F.floor(value).cast("int")).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    c = h.select(*keys, "bin", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(up).alias("s0"), F.sum("n").over(all_).alias("w"), F.sum(F.col("n") * F.col("bin")).over(all_).alias("s"), (F.max("bin").over(all_) - F.min("bin").over(all_)).alias("spread"))
    rest = F.col("w") - F.col("w0")
    between = F.when(rest > 0, F.col("w0") * rest * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / rest, 2)).otherwise(0.0)
    return c.groupBy(*keys).agg(F.max_by("bin", F.struct(F.round(between, 3), -F.col("bin"))).alias("threshold"), (F.max("spread") > spread).alias("usable"))


def shaded(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells darker than their sheet's threshold; none on sheets without spread."""
    t = otsu(cells, keys, value)
    return cells.join(t, keys).where(F.col("usable") & (F.col(value) <= F.col("threshold"))).drop("usable", "threshold")


def runs(glyphs: DataFrame, baseline: float = 0.6, back: float = 0.10, forward: float = 0.55) -> DataFrame:
    """Glyphs (doc_id, page, gi, text, x0, x1, top, size) joined to the runs they were printed as: each continues the run on
    its baseline whose end is nearest, within the kerning limits (in em), or opens one."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_t=pdf["top"].round(1)).sort_values(["_t", "x0", "gi"])
        ends: list[list[float]] = []
        member = []
        for g in pdf.itertuples():
            em = g.size if g.size and g.size > 0 else 8.0
            near = [(abs(g.x0 - e[1]), k) for k, e in enumerate(ends) if abs(e[0] - g.top) <= baseline and -back * em <= g.x0 - e[1] <= forward * em]
            if near:
                k = min(near)[1]
                ends[k][1] = max(ends[k][1], g.x1)
            else:
                k = len(ends)
                ends.append([g.top, g.x1])
            member.append(k)
        pdf["run"] = member
        out = pdf.groupby("run").agg(top=("top", "first"), x0=("x0", "first"), x1=("x1", "max"), text=("text", lambda t: re.sub(r"\s+", " ", "".join(t)).strip())).reset_index()
        out["doc_id"], out["page"] = pdf["doc_id"].iloc[0], pdf["page"].iloc[0]
        out["glyphs"] = [pdf.loc[pdf["run"] == r, "gi"].tolist() for r in out["run"]]
        return out[["doc_id", "page", "run", "top", "x0", "x1", "text", "glyphs"]]

    return glyphs.groupBy("doc_id", "page").applyInPandas(page, "doc_id string, page int, run int, top double, x0 double, x1 double, text string, glyphs array<int>")


def evicted(runs_: DataFrame, cells: DataFrame, edge: float = 0.5, baseline: float = 0.6) -> DataFrame:
    """Runs that overprint a cell: (doc_id, page, row, col, run) where a run with glyphs in the cell leaves it and overlaps
    one on its baseline that stays inside. ``cells``: runs present (doc_id, page, row, col, run, c_x0, c_x1)."""
    own = cells.join(runs_.select("doc_id", "page", "run", "top", "x0", "x1"), ["doc_id", "page", "run"])
    fits = (F.col("x0") >= F.col("c_x0") - edge) & (F.col("x1") <= F.col("c_x1") + edge)
    keep = own.where(fits).select("doc_id", "page", "row", "col", F.col("top").alias("_t"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    over = own.where(~fits)
    hit = (F.abs(F.col("top") - F.col("_t")) <= baseline) & (F.col("x0") < F.col("_x1")) & (F.col("_x0") < F.col("x1"))
    return over.join(keep, ["doc_id", "page", "row", "col"]).where(hit).select("doc_id", "page", "row", "col", "run").distinct()


def rehomed(gone: DataFrame, runs_: DataFrame, cells: DataFrame, present: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, text): an evicted run as a whole in the column of its row that its centre falls in, if that cell holds
    nothing but this run's own pieces. ``gone``: doc_id, page, row, run; ``cells``: doc_id, page, row, col, c_x0, c_x1; ``present``: the runs with glyphs in each
    cell (doc_id, page, row, col, run)."""
    own = gone.select("doc_id", "page", "row", "run").distinct().join(runs_.select("doc_id", "page", "run", "text", ((F.col("x0") + F.col("x1")) / 2).alias("_c")), ["doc_id", "page", "run"])
    home = own.join(cells, ["doc_id", "page", "row"]).where((F.col("c_x0") <= F.col("_c")) & (F.col("_c") < F.col("c_x1")))
    home = home.groupBy("doc_id", "page", "row", "run").agg(F.min(F.struct("col", "text")).alias("h")).select("doc_id", "page", "row", "run", "h.*")
    held = present.groupBy("doc_id", "page", "row", "col").agg(F.min("run").alias("_lo"), F.max("run").alias("_hi"))
    return home.join(held, ["doc_id", "page", "row", "col"]).where((F.col("_lo") == F.col("run")) & (F.col("_hi") == F.col("run"))).select("doc_id", "page", "row", "col", "text")


def peaks(profile: DataFrame, limit: float) -> DataFrame:
    """Line positions from a projection (doc_id, axis, pos, value, span): positions above ``limit`` cluster where steps are
    at most max(3, span / 260); the centre is the whole mean."""
    w = Window.partitionBy("doc_id", "axis").orderBy("pos")
    gap = F.greatest(F.lit(3.0), F.col("span") / 260.0)
    own = profile.where(F.col("value") > limit).withColumn("_n", F.coalesce((F.col("pos") - F.lag("pos").over(w)) > gap, F.lit(True)).cast("int"))
    g = own.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("doc_id", "axis", "_g").agg(F.floor(F.avg("pos")).cast("int").alias("px")).drop("_g")


def trim_edges(edges: DataFrame, ratio: float = 1.8) -> DataFrame:
    """Cell edges (doc_id, idx, px) without leading and trailing columns wider than ``ratio`` medians."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        px = pdf.sort_values("idx")["px"].tolist()
        while len(px) > 3 and px[-1] - px[-2] > ratio * float(np.median(np.diff(px))):
            px.pop()
        while len(px) > 3 and px[1] - px[0] > ratio * float(np.median(np.diff(px))):
            px.pop(0)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "idx": range(len(px)), "px": px})

    return edges.groupBy("doc_id").applyInPandas(page, "doc_id string, idx int, px int")


def merged_columns(edges: DataFrame, ratio: float = 1.8) -> DataFrame:
    """Documents whose widest column is over ``ratio`` medians: the segmentation is refused."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    widths = edges.withColumn("w", F.lead("px").over(w) - F.col("px")).where("w is not null")
    return widths.groupBy("doc_id").agg((F.max("w") / F.median("w")).alias("ratio")).withColumn("refused", F.col("ratio") > ratio)


CODE = r"\b([A-Z]{1,3}[- ]?\d{2,4}[A-Z]?)\b"
DECIMAL = r"\d{1,3}[.,]\d{1,2}"


def profile_columns(cells: DataFrame, widths: DataFrame, markers: list[str], least_width: int) -> DataFrame:
    """Per (doc_id, col): width, rows with a name marker, codes, decimals, Bengali share and the longest text, from
    readings (doc_id, row, col, lang, text)."""
    bn, en = F.col("lang") == "ben", F.col("lang") == "eng"
    marker = F.lit(False)
    for m in markers:
        marker = marker | F.contains("text", F.lit(m))
    letters = F.regexp_count("text", F.lit("[ঀ-৿]"))
    solid = F.char_length(F.regexp_replace("text", r"\s+", ""))
    p = cells.groupBy("doc_id", "col").agg(
        F.count_if(bn & marker).alias("kv"), F.count_if(en & F.upper("text").rlike(CODE)).alias("codes"), F.count_if(en & F.col("text").rlike(DECIMAL)).alias("decimals"),
        F.coalesce(F.max(F.when(bn, F.char_length("text"))), F.lit(0)).alias("longest"), F.coalesce(F.sum(F.when(bn, letters)) / F.sum(F.when(bn, solid)), F.lit(0.0)).alias("bn_ratio"),
    )
    return p.join(widths, ["doc_id", "col"]).withColumn("is_text", (F.col("width_px") >= least_width) & (F.col("bn_ratio") > 0.4))


def column_roles(cells: DataFrame, widths: DataFrame, markers: list[str], least_width: int = 100) -> DataFrame:
    """(doc_id, role, col): area is the longest text; name has a marker on two rows or shares a word with the first area on
    two; code reads as a code on two; load has decimals on two. Roles may be absent."""
    p = profile_columns(cells, widths, markers, least_width)
    texts = p.where("is_text").withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("longest"), F.desc("width_px"), "col")))
    kv = p.where("kv >= 2").groupBy("doc_id").agg(F.max_by("col", F.struct("kv", -F.col("col"))).alias("kv_col"))
    first = texts.where("r = 1").select("doc_id", F.col("col").alias("area1"))
    second = texts.where("r = 2").select("doc_id", F.col("col").alias("area2"))
    base = first.join(second, "doc_id", "left").join(kv, "doc_id", "full_outer")
    base = base.withColumn("area", F.when((F.col("area1") == F.col("kv_col")) & F.col("area2").isNotNull(), F.col("area2")).otherwise(F.col("area1")))
    bn = cells.where("lang = 'ben'").select("doc_id", "row", "col", "text")
    split = lambda c: F.filter(F.split(c, r"[\s,،৷/]+"), lambda w: F.char_length(w) >= 3)
    area = base.select("doc_id", F.col("area").alias("col")).join(bn, ["doc_id", "col"]).select("doc_id", "row", F.get(F.split("text", "[,،৷/]"), F.lit(0)).alias("lead"), F.col("col").alias("area"))
    other = texts.where("r > 1").select("doc_id", "col").join(bn, ["doc_id", "col"]).join(area, ["doc_id", "row"]).where("col < area")
    named = F.regexp_count("text", F.lit("[ঀ-৿]")) >= 3
    by = other.groupBy("doc_id", "col").agg(F.count_if(F.arrays_overlap(split("text"), split("lead"))).alias("shared"), F.countDistinct(F.when(F.col("text") != "", F.col("text"))).alias("distinct"), F.countDistinct(F.when(named, F.col("text"))).alias("named"))
    words = by.where("shared >= 2 and distinct >= 3 and named * 2 >= distinct").groupBy("doc_id").agg(F.max_by("col", F.struct("shared", -F.col("col"))).alias("word_col"))
    roles = base.join(words, "doc_id", "left").withColumn("name", F.coalesce("kv_col", "word_col")).select("doc_id", "area", "name")
    free = p.join(roles, "doc_id", "left").where((~F.col("col").eqNullSafe(F.col("area"))) & (~F.col("col").eqNullSafe(F.col("name"))))
    code = free.where("codes >= 2").groupBy("doc_id").agg(F.min("col").alias("code"))
    load = free.join(code, "doc_id", "left").where(~F.col("col").eqNullSafe(F.col("code")) & (F.col("decimals") >= 2)).groupBy("doc_id").agg(F.max_by("col", F.struct("decimals", -F.col("col"))).alias("load"))
    wide = p.select("doc_id").distinct().join(roles, "doc_id", "left").join(code, "doc_id", "left").join(load, "doc_id", "left")
    return wide.unpivot("doc_id", ["area", "name", "code", "load"], "role", "col").where("col is not null")


def feeder_label(code: Column, name: Column, row: Column) -> Column:
    """A scan row's label: code, else name, else its position."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(blank(code), blank(name), F.format_string("row-%02d", row))


def read_choice(readings: DataFrame, keys: list[str], factor: float = 1.5) -> DataFrame:
    """One reading per cell: the first mode's, unless another is over ``factor`` times as long (readings: keys, mode, text)."""
    first = F.min_by("text", "mode")
    longest = F.max_by("text", F.struct(F.char_length("text"), -F.col("mode")))
    g = readings.groupBy(*keys).agg(first.alias("a"), longest.alias("b"))
    return g.select(*keys, F.when(F.char_length("b") > factor * F.char_length("a"), F.col("b")).otherwise(F.col("a")).alias("text"))
