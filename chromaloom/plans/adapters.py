"""Views that turn the star-schema tables into reads, contigs, links, orderings and intervals.

Each view is one SQL text; Spark runs it over the Parquet tables, and the DuckDB
checks prepend it as a common table expression.  ``STR`` stands for the string
type and ``TRUNC`` for truncation toward zero, which the two spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

VIEWS = {
    "contigs": """select cast(p_partkey as int) as tid, concat('ctg_', cast(p_partkey as STR)) as name,
        cast(20000 + p_size * 5000 as bigint) as len, cast(p_size as bigint) as re_raw, cast(p_size + 1 as bigint) as re from part""",
    "reads": """select l_orderkey as qid, cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as int) as ord,
        cast(l_partkey as int) as tid, cast(floor(l_extendedprice) as bigint) % 20000 as pos,
        cast(floor(l_quantity) as int) % 10 as mapq, case when l_tax > 0.075 then 4 else 0 end as flag from lineitem""",
    "pairs": """select a.qid, a.ord as ord1, b.ord as ord2, a.tid as tid1, b.tid as tid2,
        a.pos as pos1, b.pos as pos2, a.mapq as mapq1, b.mapq as mapq2
        from reads a join reads b on a.qid = b.qid and a.ord < b.ord where a.flag = 0 and b.flag = 0""",
    "truth": """select tid, case when tid % 17 = 0 then null else (tid * 7) % 24 end as chrom,
        (tid * cast(7919 as bigint)) % 1000003 as t0, (tid * cast(7919 as bigint)) % 1000003 + len as t1, tid % 3 = 0 as rc,
        (tid % 10) / 10.0e0 as alignability, (100 - tid % 20) / 100.0e0 as specificity from contigs""",
    "clusters": """select tid, (tid * 7) % 24 as true_c,
        case when tid % 11 = 0 then tid % 23 else (tid * 7) % 24 end as cluster_id from contigs where tid % 13 <> 0""",
    "ordering": """select c.cluster_id, c.tid, cast(row_number() over (partition by c.cluster_id
            order by t.t0 + (c.tid % 5) * 3000, c.tid) - 1 as int) as pos,
        c.tid % 7 = 0 as rc, cast(c.tid % 9 as double) as q
        from clusters c join truth t on c.tid = t.tid where c.tid % 10 <> 3""",
    "intervals": """select event_id as id, cast(user_id % 24 as int) as chr_id, cast(floor(value * 100) as bigint) as a,
        cast(floor(value * 100) as bigint) + 50 + event_id % 400 as b, cast(event_id % 4 as int) as cn from events""",
    "sequences": """select doc_id as sid, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as seq from documents""",
    "observations": """select user_id as seq_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as t,
        event_type as symbol from events""",
    "hits": """select cast(l_partkey as int) as query_id, cast(l_suppkey % 24 as int) as target, l_orderkey as hit,
        cast(1 + (l_orderkey * 37 + l_linenumber * 101) % 9000 as int) as q_start,
        cast(1 + (l_orderkey * 37 + l_linenumber * 101) % 9000 + 50 + l_suppkey % 700 as int) as q_end from lineitem""",
}

_DEPENDS = {name: [v for v in VIEWS if v != name and re.search(rf"\b(from|join) {v}\b", text)] for name, text in VIEWS.items()}


def _counted(text: str) -> str:
    """``count_if(x)`` as a filtered count, whose type is a plain long."""
    while (at := text.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(*) filter (where {text[at + len('count_if(') : end - 1]}){text[end:]}"
    return text


def _spelled(text: str, engine: str) -> str:
    string = {"spark": "string", "duckdb": "varchar"}[engine]
    truncate = {"spark": r"cast(\1 as bigint)", "duckdb": r"cast(trunc(\1) as bigint)"}[engine]
    return re.sub(r"TRUNC\[(.*?)\]", truncate, re.sub(r"\bSTR\b", string, text))


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        out += [n for n in [*_needed(_DEPENDS[name]), name] if n not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables below ``sf_dir``."""
    chain = ", ".join(f"{n} as ({_spelled(VIEWS[n], 'spark')})" for n in _needed([name]))
    text = f"with {chain} select * from {name}"
    used = [t for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", text)]
    text = re.sub(rf"\b(from|join) ({'|'.join(used)})\b", r"\1 {\2}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in used})


def duckdb_text(query: str, **more: str) -> str:
    """A check: ``query`` with the views that it names, and further common table expressions, in front."""
    whole = " ".join([*more.values(), query])
    names = _needed([v for v in VIEWS if re.search(rf"\b{v}\b", whole)])
    parts = [f"{n} as ({VIEWS[n]})" for n in names] + [f"{n} as ({t})" for n, t in more.items()]
    return _counted(_spelled(f"with {', '.join(parts)} {query}" if parts else query, "duckdb"))
