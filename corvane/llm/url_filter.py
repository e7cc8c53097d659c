"""URL filters: allow and block rules, and a weighted vocabulary of suspicious terms.

Host, path and rules are column expressions.  Terms are counted by an
Aho-Corasick automaton over the whole URL with A-Z lower-cased and escaped
letters and digits unescaped.  A hit needs a boundary, no ASCII letter, on both
sides, so ``casino777`` and ``%63asino`` are hits and ``casinos`` is not.  The
weights of the distinct terms are added up: one strict term reaches the limit,
and so do several distinct soft ones.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms by class.
STRICT = (
    "bestiality", "blackjack", "camgirl", "camgirls", "casino", "cialis", "dickpic", "escort", "escorts", "fetish", "gangbang", "hentai", "hookup", "incest",
    "keygen", "keylogger", "levitra", "malware", "milf", "onlyfans", "phishing", "porn", "porno", "ransomware", "roulette", "sexcam", "slotmachine",
    "spielautomaten", "sportwetten", "spyware", "torrent", "torrents", "tramadol", "trojan", "viagra", "warez", "webcam", "xnxx", "xvideos", "xxx",
)
SOFT = (
    "adult", "ads", "affiliate", "apuestas", "banner", "bet", "bets", "betting", "bitcoin", "bonus", "cash", "cheap", "cheat", "click", "clicks", "coupon",
    "crack", "cracked", "credit", "crypto", "dating", "deal", "deals", "discount", "erotic", "forex", "free", "gratis", "gratuit", "hot", "jackpot", "kostenlos",
    "loan", "loans", "lottery", "nude", "offer", "payday", "pharma", "pharmacy", "pills", "poker", "popup", "prize", "promo", "redirect", "sex", "sexy", "singles",
    "slots", "tracker", "tracking", "track", "wager", "weight", "win", "winner",
)
STRICT_WEIGHT, SOFT_WEIGHT, LIMIT = 1.0, 0.5, 1.0
VOCABULARY = dict.fromkeys(STRICT, STRICT_WEIGHT) | dict.fromkeys(SOFT, SOFT_WEIGHT)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Escapes of letters and digits once A-Z are lower-cased, replaced in this order.
_ESCAPES = [(f"%{ord(c):02x}", c) for c in "0123456789" + _LOWER] + [(f"%{ord(c):02x}", c.lower()) for c in _UPPER]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host (or a parent domain) and path; null if none."""
    found = None
    for verdict, domain, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        value = F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def plain_url(url: str) -> str:
    """A-Z lower-cased, escaped ASCII letters and digits as themselves."""
    text = url.translate(str.maketrans(_UPPER, _LOWER))
    if "%" in text:
        for escape, c in _ESCAPES:
            text = text.replace(escape, c)
    return text


def term_counts(vocabulary: Mapping[str, float] = VOCABULARY, limit: float = LIMIT):
    """A pandas UDF: url -> struct of hits and distinct terms, strict (those that reach ``limit`` alone) and soft, and the weight of the distinct terms."""

    @F.pandas_udf("strict_hits int, strict_terms int, soft_hits int, soft_terms int, weight double")
    def count(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()
        letters = set(_LOWER)

        def judge(url: str | None) -> tuple[int, int, int, int, float]:
            hits: list[list[str]] = [[], []]
            text = plain_url(url or "")
            for end, (term, weight) in automaton.iter(text) if text else ():
                start = end - len(term)
                if (start < 0 or text[start] not in letters) and (end + 1 >= len(text) or text[end + 1] not in letters):
                    hits[weight < limit].append(term)
            strict, soft = map(set, hits)
            return len(hits[0]), len(strict), len(hits[1]), len(soft), float(sum(vocabulary[t] for t in strict | soft))

        for batch in urls:
            yield pd.DataFrame([judge(u) for u in batch], columns=["strict_hits", "strict_terms", "soft_hits", "soft_terms", "weight"])

    return count


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Mapping[str, float] = VOCABULARY, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, the four counts of terms and their weight.

    The verdict is the longest fitting rule's; without one, block if the
    distinct terms weigh ``limit`` or more, else allow.  A null or empty URL
    has no host, path or terms and is allowed; URLs of any length are read
    whole; rows that repeat are judged each; other columns are not read, so
    names may clash; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    split = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), term_counts(vocabulary, limit)("url").alias("terms"))
    ruled = split.withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("ruled.verdict", F.when(F.col("terms.weight") >= limit, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "terms.*")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("strict_hits", "soft_hits")


def _sql() -> str:
    count = lambda terms: " + ".join(f"(regexp_matches(low, '(^|[^a-z]){t}([^a-z]|$)'))::INT" for t in terms)
    plain = "low"
    for escape, c in _ESCAPES:
        plain = f"replace({plain}, '{escape}', '{c}')"
    rules = " ".join(
        f"WHEN (host = '{d}' OR host LIKE '%.{d}') AND starts_with(path, '{p}') THEN '{v} {d}{p}'" for v, d, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, CASE WHEN contains(low, '%') THEN {plain} ELSE low END AS low, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, low, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, ({count(STRICT)})::INT AS strict_terms, ({count(SOFT)})::INT AS soft_terms, CASE {rules} END AS ruled FROM c),
e AS (SELECT *, strict_terms * {STRICT_WEIGHT}::DOUBLE + soft_terms * {SOFT_WEIGHT}::DOUBLE AS weight FROM d)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, split_part(ruled, ' ', 2) AS rule,
       coalesce(split_part(ruled, ' ', 1), CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_terms, soft_terms, weight
FROM e
"""


SQL = _sql()
