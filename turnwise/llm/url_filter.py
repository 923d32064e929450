"""URL filter: rules by host and path, and a weighted vocabulary counted by Aho-Corasick.

One pass over a url finds all terms of the vocabulary. A hit counts only between boundaries: no letter or
digit of ASCII before or after it. One strict term rejects a url, and so do several distinct soft terms. A rule
that fits decides before the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary and the rules of the registered query.
STRICT = ("casino", "porn", "viagra", "xxx", "jackpot", "escort")
SOFT = ("cheap", "pills", "free", "bets", "win", "spam", "farm", "ads", "track", "bonus", "loan", "slots")
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the host, or a domain above it, and starts the path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decision in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    """The vocabulary; a term in both lists is strict."""
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    if len(found):
        found.make_automaton()
    return found


def _is_word(character: str) -> bool:
    return character.isascii() and character.isalnum()


def hits(url: str | None, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Numbers of distinct strict and soft terms between boundaries."""
    if not url or not len(terms):
        return 0, 0
    text = url.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    strict, soft = set(), set()
    for last, (term, hard) in terms.iter(text):
        first = last - len(term) + 1
        if (first and _is_word(text[first - 1])) or (last + 1 < len(text) and _is_word(text[last + 1])):
            continue
        (strict if hard else soft).add(term)
    return len(strict), len(soft)


def filter_urls(
    pages: DataFrame,
    *,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_limit: int = 2,
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """Judge every row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``strict_hits``, ``soft_hits``.

    ``verdict`` is that of the longest fitting rule, else ``block`` for a strict term or ``soft_limit`` distinct soft ones, else
    ``allow``. A null url, or one without ``://``, has an empty host and path; a null one is allowed. Repeated rows and null
    ids are judged like any other. Other columns are not looked at.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            found = [hits(url, terms) for url in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x[0] for x in found], pa.int32()),
                    pa.array([x[1] for x in found], pa.int32()),
                ],
                ["page_id", "url", "strict_hits", "soft_hits"],
            )

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    counted = plain.mapInArrow(run, "page_id long, url string, strict_hits int, soft_hits int")
    host, path = split_url(F.col("url"))
    rule, decision = fitting_rule(F.col("host"), F.col("path"), rules)
    bad = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit)
    return counted.withColumns({"host": host, "path": path}).select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(decision, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "strict_hits",
        "soft_hits",
    )


def _hit_sql(terms: Sequence[str]) -> str:
    return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)


def url_filter_sql() -> str:
    """The registered query in DuckDB SQL."""
    fits = [
        (f"{h}{p}", f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", v)
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    names = " ".join(f"WHEN {cond} THEN '{name}'" for name, cond, _ in fits)
    verdicts = " ".join(f"WHEN {cond} THEN '{verdict}'" for _, cond, verdict in fits)
    return f"""
        WITH cut AS (
            SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low,
                   CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        hosted AS (
            SELECT *, regexp_extract(rest, '^[^/?#]*') AS plain FROM cut),
        parts AS (
            SELECT page_id, low, translate(plain, '{UPPER}', '{LOWER}') AS host,
                   regexp_extract(substr(rest, length(plain) + 1), '^[^?#]*') AS path
            FROM hosted),
        counted AS (
            SELECT *, ({_hit_sql(STRICT)})::INT AS strict_hits, ({_hit_sql(SOFT)})::INT AS soft_hits FROM parts)
        SELECT page_id, host, path, CASE {names} END AS rule,
               CASE {verdicts} WHEN strict_hits > 0 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict,
               strict_hits, soft_hits
        FROM counted"""
