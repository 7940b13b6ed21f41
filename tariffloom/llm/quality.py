"""Quality rules for documents and, through them, for their hosts.

Each document gets a few counts and rule outcomes.  Failures are added up by host, a host's
failure rate is shrunk towards the rate of all hosts by a beta prior whose two parameters come
from the hosts themselves (method of moments), and the host's verdict goes back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffloom.llm.common import ASCII_SPACE, WORD, cut_lineage, group_key, table, text_of

SYMBOLS = "#*$%&|<>"
HOST_LIMIT = 0.5
#: prior strength where the hosts differ no more than chance makes them
FIRM = 1e6


def rules() -> dict[str, Column]:
    """Rule name -> true where a document fails it."""
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 100 * F.col("n_words"),
        "dup_lines": (F.col("n_lines") > 1) & (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    }


BASE = ("short", "repeats")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: words, characters in words, symbols, repeated lines, words in repeated 3-word windows.

    Windows are put in order within the document, so that equal ones are neighbours; nothing but
    the counts leaves the row.
    """
    text, lit = F.col("__text"), F.lit
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text_of(text_col).alias("__text"))
    words = base.select(
        "doc_id", "host", F.regexp_extract_all("__text", lit(WORD), lit(0)).alias("__w"),
        F.length(_without(text, ASCII_SPACE)).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, ASCII_SPACE)) > 0).alias("__lines"),
    )
    w = F.col("__w")
    windows = F.when(F.size(w) >= 3, F.transform(
        F.sequence(lit(0), F.size(w) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")),
    )).otherwise(F.array().cast("array<struct<g:string,i:int>>"))
    ordered = words.select(
        "doc_id", "host", F.size(w).cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(windows).alias("__g"),
    )
    g = F.col("__g")
    same = lambda x, j: x["g"].eqNullSafe(F.get(g, j)["g"])
    repeated = F.sort_array(F.array_compact(F.transform(g, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))))
    at = ordered.select("*", repeated.alias("__at")).drop("__g")
    p = F.col("__at")
    covered = F.aggregate(
        F.transform(p, lambda x, j: F.coalesce(F.least(lit(3), F.get(p, j + 1) - x), lit(3))), lit(0).cast("bigint"), lambda a, x: a + x)
    return at.select("*", covered.alias("n_repeat_words")).drop("__at")


def beta_prior(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Per rule the beta parameters fitted to the hosts' rates; one row of sums reaches the driver."""
    rate = {r: F.col(r) / F.col("n") for r in names}
    got = hosts.agg(*[x for r in names for x in (
        F.avg(rate[r]).alias(f"m_{r}"), F.var_samp(rate[r]).alias(f"v_{r}"))], F.avg(1 / F.col("n")).alias("inv")).first()
    prior = {}
    for r in names:
        mean, var = got[f"m_{r}"] or 0.0, (got[f"v_{r}"] or 0.0)
        spread = mean * (1 - mean)
        beyond = var - spread * (got["inv"] or 0.0)
        strength = FIRM if beyond <= 0 or spread <= 0 else min(FIRM, max(1.0, spread / beyond - 1))
        prior[r] = (mean * strength, (1 - mean) * strength)
    return prior


def host_verdicts(docs: DataFrame, limit: float = HOST_LIMIT, **columns: str) -> DataFrame:
    """Documents with counts, ``base_failed``, their host's shrunk rates and ``kept``.

    A null text has no words and so fails; documents without a host form a host of their own;
    equal rows count each; an empty table gives an empty result.  Columns other than id, text and
    host are ignored, so names cannot clash.
    """
    tests = rules()
    counts = document_counts(docs, **columns)
    failed = counts.select("*", *[c.alias(f"failed_{r}") for r, c in tests.items()], group_key("host").alias("key"))
    failed = cut_lineage(failed)
    hosts = cut_lineage(failed.groupBy("key").agg(F.count("*").alias("n"), *[F.sum(F.col(f"failed_{r}").cast("long")).alias(r) for r in tests]))
    prior = beta_prior(hosts, list(tests))
    shrunk = {r: (F.col(r) + prior[r][0]) / (F.col("n") + prior[r][0] + prior[r][1]) for r in tests}
    verdict = hosts.select("key", *[c.alias(f"host_{r}") for r, c in shrunk.items()])
    base_failed = F.col(f"failed_{BASE[0]}") | F.col(f"failed_{BASE[1]}")
    host_ok = F.greatest(*[F.col(f"host_{r}") for r in tests]) <= limit
    return failed.join(verdict, "key").withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & host_ok).drop("key")


def op6_quality_rules(spark, sf):
    return host_verdicts(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select rid, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3),
r as (select rid, i, count(*) over (partition by rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as n from g),
p as (select rid, count(distinct x) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as x from r where n > 1) group by rid),
l as (select rid, unnest(string_split(t, chr(10))) as line from d),
m as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
      from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
c as (
  select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from d left join p using (rid) left join m using (rid)),
f as (
  select *, n_words < 50 as f1, 100 * n_repeat_words > 50 * n_words as f2, 100 * n_symbols > 100 * n_words as f3,
         n_lines > 1 and 100 * n_dup_lines > 50 * n_lines as f4 from c),
h as (
  select source, rule, count(*)::double as n, sum(failed::int)::double as bad
  from (select source, unnest(['1', '2', '3', '4']) as rule, unnest([f1, f2, f3, f4]) as failed from f) group by source, rule),
b as (
  select rule, avg(bad / n) as mean, avg(bad / n) * (1 - avg(bad / n)) as spread,
         coalesce(var_samp(bad / n), 0) - avg(bad / n) * (1 - avg(bad / n)) * avg(1 / n) as beyond from h group by rule),
k as (select rule, mean, case when beyond <= 0 or spread <= 0 then 1e6 else least(1e6, greatest(1.0, spread / beyond - 1)) end as strength from b),
v as (select source, max((bad + mean * strength) / (n + strength)) <= 0.5 as host_ok from h join k using (rule) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 or f2 as base_failed, not (f1 or f2) and host_ok as kept
from f join v on f.source is not distinct from v.source
"""
