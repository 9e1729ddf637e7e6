"""URL filters: pattern rules indexed by their rarest literal token.

Each rule names literal tokens that any URL it matches has to hold. How often these tokens occur in the
URLs at hand decides under which one a rule is filed. A URL's tokens fetch the rules filed under them,
and only those run their regular expressions; the first rule of the list that matches decides.
Above the patterns stand host rules (host and start of the path), of which the longest that fits wins.

Defined results: a null URL or one without "://" has an empty host and path and no host rule; no rule
that matches means allow; repeated rows are judged each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Literal tokens (lower case), regular expression over the lower-cased URL, verdict.
PATTERNS: list[tuple[tuple[str, ...], str, str]] = [
    (("spam", "farm"), r"^[^/]*//[^/?#]*\bspam-farm\b", "block"),
    (("cheap", "pills"), r"^[^/]*//[^/?#]*\bcheap-pills\b", "block"),
    (("casino",), r"\bcasino\b", "block"),
    (("adult",), r"^[^/]*//[^/?#]*\badult\b", "block"),
    (("free", "download"), r"\bfree\b.*\bdownload\b", "block"),
    (("login",), r"//[^/?#]*/(?:[^?#]*/)?login(?:[/?#.]|$)", "block"),
    (("click",), r"//[^/?#]*/(?:[^?#]*/)?click\?", "block"),
]
_TOKEN = re.compile(r"[a-z0-9]+")
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def host_path(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs; as many rows as the rules have tokens at most."""
    of_url = F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))
    wanted = F.array_intersect(of_url, F.array(*map(F.lit, sorted(tokens)))) if tokens else F.array().cast("array<string>")
    return {r[0]: r[1] for r in urls.select(F.explode(wanted).alias("token")).groupBy("token").count().collect()}


def index_rules(patterns: list, counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules by their rarest token; rules without a token under the empty one, which every URL has."""
    out: dict[str, list[int]] = defaultdict(list)
    for i, (tokens, _, _) in enumerate(patterns):
        out[min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else ""].append(i)
    return dict(out)


def filter_urls(pages: DataFrame, host_rules: list | None = None, patterns: list | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (number of the pattern that decided) of each row of pages."""
    host_rules, patterns = host_rules or HOST_RULES, PATTERNS if patterns is None else patterns
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    index = index_rules(patterns, token_counts(urls, {t for p in patterns for t in p[0]}))
    ordered = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for r, v in sorted(host_rules, key=lambda x: -len(x[0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p) for _, p, _ in patterns]

        def judge(url: str | None) -> tuple:
            host, path = host_path(url)
            for h, start, rule, verdict in ordered:
                if (host == h or host.endswith("." + h)) and path.startswith(start):
                    return host, path, rule, verdict, None
            low = (url or "").lower()
            for i in sorted({i for t in {"", *_TOKEN.findall(low)} for i in index.get(t, ())}):
                if compiled[i].search(low):
                    return host, path, None, patterns[i][2], i
            return host, path, None, "allow", None

        for batch in batches:
            host, path, rule, verdict, number = zip(*map(judge, batch.column(1).to_pylist())) if batch.num_rows else ((),) * 5
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text(host), text(path), text(rule), text(verdict), pa.array(number, pa.int32())], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern int")
