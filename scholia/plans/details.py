"""Queries of small functions that others don't exercise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import questions as Q
from ..operators import rewards as R
from .registry import Tables, query


@query(r"""SELECT doc_id, trim(replace(replace(coalesce(text, ''), chr(8232), ' '), chr(8233), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, (n_chars * 1013 * 200 + 1048576) // 2097152 / 100.0::DOUBLE AS megabytes
FROM (SELECT doc_id, n_chars, replace(text, '. ', '.' || chr(8232)) AS text FROM documents)""")
def str_lines(t: Tables) -> DataFrame:
    """Texts without line and paragraph separators, and sizes in megabytes."""
    rows = t.documents.select("doc_id", "n_chars", F.replace("text", F.lit(". "), F.lit(".\u2028")).alias("text"))
    return rows.select("doc_id", Q.one_line(F.col("text")).alias("line"), N.megabytes(F.col("n_chars") * 1013).alias("megabytes"))


@query("""SELECT l_orderkey, count(*) AS rollouts, count(DISTINCT (l_returnflag, l_linestatus)) AS contexts, count(*) % 2 = 0 AND count(DISTINCT (l_returnflag, l_linestatus)) = 1 AS complete FROM lineitem GROUP BY l_orderkey""")
def hsh_contexts(t: Tables) -> DataFrame:
    """Whether an order's lines, as rollouts two by two, are of one context."""
    return R.rollout_groups(t.lineitem, "l_orderkey", ["l_returnflag", "l_linestatus"], 2)
