"""Text clean steps that are plain Catalyst expressions (H3, H5, P9), the
step registry (X1) and the LLM post-clean hook (H8)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webweft.functions.hashing import sha256_hex
from webweft.functions.text import _c, is_blank, where
from webweft.session import cut_lineage

# --- fixed values (data-URI patterns, applied in this order, case-insensitive) ---
DATA_URI_PATTERNS = [
    r"""src\s*=\s*['"]data:image/[^'"]+['"]""",
    r"""src\s*=\s*['"]data:video/[^'"]+['"]""",
    r"""src\s*=\s*['"]data:audio/[^'"]+['"]""",
    r"""href\s*=\s*['"]data:[^'"]+['"]""",
    r"""url\(data:[^)]+\)""",
]
# ---------------------------------------------------------------------------------

HTML_STAGE, MARKDOWN_STAGE = 1, 2


def strip_data_uris(col) -> Column:
    """H3."""
    def stripped(c: Column) -> Column:
        for p in DATA_URI_PATTERNS:
            c = F.regexp_replace(c, "(?i)" + p, "")
        return c

    return where(lambda c: c.rlike("(?i)data:"), stripped)(_c(col))


def normalise_whitespace(col) -> Column:
    """H5: runs of 2+ spaces → one; trailing spaces/tabs per line removed
    (``\\n`` is the only line end); 2+ newlines → exactly 2."""
    def trails(c: Column) -> Column:
        return c.contains(" \n") | c.contains("\t\n") | c.endswith(" ") | c.endswith("\t")

    c = where(lambda c: c.contains("  "), lambda c: F.regexp_replace(c, " {2,}", " "))(_c(col))
    c = where(trails, lambda c: F.regexp_replace(c, r"(?md)[ \t]+$", ""))(c)
    return where(lambda c: c.contains("\n\n\n"), lambda c: F.regexp_replace(c, r"\n{2,}", "\n\n"))(c)


def content_hash(col) -> Column:
    """P9."""
    return sha256_hex(col)


# --- X1: clean-step registry ---------------------------------------------------------

@dataclass(order=True)
class Step:
    stage: int
    order: int
    name: str = field(compare=False)
    fn: Callable = field(compare=False)   # Column -> Column, or (DataFrame, text column) -> DataFrame
    frame: bool = field(default=False, compare=False)


class StepRegistry:
    """Steps run sorted by (stage, order) (T3); a stage stops for a row once
    its text is blank (guarded by ``when``)."""

    def __init__(self):
        self.steps: list[Step] = []

    def register_step(self, stage: int, order: int, fn, name: str | None = None, frame: bool = False):
        self.steps.append(Step(stage, order, name or getattr(fn, "__name__", "step"), fn, frame))
        return self

    def run_stage(self, df: DataFrame, stage: int, text_col: str = "text") -> DataFrame:
        for st in sorted(s for s in self.steps if s.stage == stage):
            if st.frame:
                df = st.fn(df, text_col)
            else:
                df = df.withColumn(text_col, F.when(is_blank(text_col), F.col(text_col))
                                   .otherwise(st.fn(F.col(text_col))))
        return df


# --- H8: LLM post-clean ---------------------------------------------------------------

USAGE_FIELDS = ["model", "prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens",
                "cache_hit_tokens", "cache_miss_tokens"]
USAGE_DDL = ("model string, prompt_tokens int, completion_tokens int, total_tokens int, "
             "reasoning_tokens int, cache_hit_tokens int, cache_miss_tokens int")


def ai_clean(df: DataFrame, cleaner: Callable[[str], tuple[str, dict | None]] | None,
             text_col: str = "markdown", use_ai_col: str = "use_ai") -> DataFrame:
    """H8: the user-supplied ``cleaner(text) -> (text, usage)`` runs once per
    distinct text of the rows that ask for it.

    Only texts are sent to it: rows that want AI and have one.  They are
    reduced to one row per content hash (in each task first), cleaned, written
    once, and joined back; all other rows pass by.  A blank text becomes
    empty and is not marked as cleaned; a failing call keeps the input and is not
    marked either (D4)."""
    usage_type = f"struct<{USAGE_DDL}>"
    out = df.withColumn("content_hash", F.when(F.col(use_ai_col), content_hash(F.col(text_col))))
    if cleaner is None:
        return (out.withColumn("ai_cleaned", F.lit(False))
                .withColumn("usage", F.lit(None).cast(usage_type)))
    out = cut_lineage(out, "before_ai")  # both sides of the split read it
    asks = F.coalesce(F.col(use_ai_col), F.lit(False)) & ~is_blank(text_col)
    texts = out.filter(asks).groupBy("content_hash").agg(F.min(text_col).alias("_text"))

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf["_text"]:
                try:
                    res, usage = cleaner(t)
                    rows.append(((res or "").strip(), True, usage))
                except Exception:  # noqa: BLE001 - a failing call keeps the input
                    rows.append((t, False, None))
            texts_out, oks, usages = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"content_hash": pdf["content_hash"], "_clean": list(texts_out),
                                "ai_cleaned": list(oks), "usage": list(usages)})

    answers = cut_lineage(texts.mapInPandas(run, T.StructType([
        T.StructField("content_hash", T.StringType()), T.StructField("_clean", T.StringType()),
        T.StructField("ai_cleaned", T.BooleanType()), T.StructField("usage", T.StructType.fromDDL(USAGE_DDL))])), "ai_texts")
    done = out.filter(asks).join(answers, "content_hash").withColumn(text_col, F.col("_clean"))
    blank = F.coalesce(F.col(use_ai_col), F.lit(False)) & F.col(text_col).isNotNull()
    rest = (out.filter(~asks).withColumn(text_col, F.when(blank, F.lit("")).otherwise(F.col(text_col)))
            .withColumn("ai_cleaned", F.lit(False)).withColumn("usage", F.lit(None).cast(usage_type)))
    return done.select(*rest.columns).unionByName(rest)
