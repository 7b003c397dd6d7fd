"""URL filter: rules by host and path first, a weighted vocabulary for all other urls.

The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, lower-cased (A-Z);
the path goes on to the next ``?``, ``#`` or the end. A rule fits its host and that host's subdomains where the path
begins with the rule's path; the longest rule (host and path together) decides.

Where no rule fits, one Aho-Corasick automaton finds all terms in one pass over the url, which is lower-cased, with
percent escapes and every run of other ASCII characters than letters and digits turned into one space. A hit counts
only at word boundaries, on the sides where its term asks for them: ``casino`` is a whole word, ``porn*`` a word's
beginning, ``*porn*`` any place. Each distinct strict term weighs ``several``, each distinct soft term one; a url whose
score reaches ``several`` is blocked, so one strict term or several distinct soft ones do it.

Defined results: a null url or one without ``://`` has an empty host and path, so that no rule fits; its terms still
count (a null or empty url has none and is allowed). Urls of any length are scanned whole. Repeated rows each get their
row; an empty table gives an empty one. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, texts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are tried one by one in the plan, terms are sent with it.
MOST_RULES, MOST_TERMS = 500, 100_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...]
    soft: tuple[str, ...]
    several: int = 2


# The rules of the contract, and the default terms.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
STRICT = tuple("*porn* *hentai* *viagra* casino* xxx nsfw milf milfs camgirl* camsex sexcam* spam spammer* warez keygen* phishing malware botnet torrents cialis levitra blackjack roulette poker gambling".split()) + ("adult x", "x rated", "adults only", "sex shop", "payday loans", "weight loss pills")
SOFT = tuple("adult adults sex sexy nude nudes naked erotic erotica fetish escort escorts hookup hookups dating singles webcam webcams cams bet bets betting bookmaker bookmakers odds jackpot jackpots slots bingo lottery win wins winner winners bonus free cheap cheapest discount discounts pill pills pharmacy meds drugs replica replicas loan loans payday forex crypto bitcoin ads adserver adserv track tracker tracking popup popups clicks affiliate affiliates banner banners doorway farm seo backlinks crack cracked cracks torrent hack hacks cheats".split())
DEFAULT = Vocabulary(STRICT, SOFT)

_OTHER = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("n_strict", pa.int64()), ("n_soft", pa.int64()), ("score", pa.int64()), ("terms", pa.list_(pa.string()))])
SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string, n_strict long, n_soft long, score long, terms array<string>"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain(url: Column) -> Column:
    """Words of a url: lower case, joined by single spaces."""
    low = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(F.regexp_replace(low, "%[0-9a-f]{2}", " "), _OTHER, " "))


def longest_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of equally long ones the first given."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    if len(ordered) > MOST_RULES:
        raise ValueError(f"{len(ordered)} rules: {MOST_RULES} at most")
    fits = [F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


class Terms:
    """The automaton over all terms and what each hit has to be bounded by."""

    def __init__(self, v: Vocabulary):
        self.automaton, self.several = ahocorasick.Automaton(), v.several
        known: dict[str, list[tuple[str, int, bool, bool]]] = {}
        for weight, terms in ((v.several, v.strict), (1, v.soft)):
            for written in dict.fromkeys(terms):
                word = re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", written.translate(str.maketrans(UPPER, LOWER))).strip()
                if word:
                    known.setdefault(word, []).append((written, weight, not written.startswith("*"), not written.endswith("*")))
        if len(known) > MOST_TERMS:
            raise ValueError(f"{len(known)} terms: {MOST_TERMS} at most")
        for word, as_written in known.items():
            self.automaton.add_word(word, (len(word), tuple(as_written)))
        if known:
            self.automaton.make_automaton()

    def found(self, text: str) -> dict[str, int]:
        """Terms, as written, and their weights; text as plain() gives it."""
        out: dict[str, int] = {}
        if not text or not len(self.automaton):
            return out
        for end, (size, as_written) in self.automaton.iter(text):
            begins = end == size - 1 or text[end - size] == " "
            ends = end + 1 == len(text) or text[end + 1] == " "
            for written, weight, left, right in as_written:
                if (begins or not left) and (ends or not right):
                    out[written] = max(weight, out.get(written, 0))
        return out


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """Per page: page_id, url, host, path, rule and verdict (the rule's, else the vocabulary's), n_strict, n_soft, score, terms."""
    url = F.col("url").cast("string")
    cut = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), plain(url).alias("plain"))
    found = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = cut.select("page_id", "url", "host", "path", found["rule"].alias("rule"), found["verdict"].alias("verdict"), "plain")

    def run(batches):
        terms = Terms(vocabulary)
        for b in batches:
            hits = [terms.found(t) for t in texts(b["plain"])]
            strict = [sum(w >= terms.several for w in h.values()) for h in hits]
            score = [sum(h.values()) for h in hits]
            verdict = [v or ("block" if s >= terms.several else "allow") for v, s in zip(b["verdict"].to_pylist(), score, strict=True)]
            yield batch(_OUT, *(b[c] for c in ("page_id", "url", "host", "path", "rule")), verdict, strict, [len(h) - n for h, n in zip(hits, strict, strict=True)], score, [sorted(h) for h in hits])

    return arrow_map(ruled, run, SCHEMA)


def allowed(pages: DataFrame, rules: Iterable[Rule] = RULES, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    """The rows of pages, whole, whose url is allowed."""
    url = F.col("url").cast("string")
    rule = longest_rule(host_of(url), path_of(url), rules)["verdict"]
    inner = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), rule.alias("verdict"), plain(url).alias("plain"))

    def run(batches):
        terms = Terms(vocabulary)
        for b in batches:
            ok = [v == "allow" if v else sum(terms.found(t).values()) < terms.several for v, t in zip(b["verdict"].to_pylist(), texts(b["plain"]), strict=True)]
            yield pa.RecordBatch.from_arrays([b["row"]], ["row"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(inner, run, inner.select("row").schema).select("row.*")


def rules_sql(rules: Iterable[Rule] = RULES, vocabulary: Vocabulary = DEFAULT) -> str:
    """DuckDB SQL over pages for page_id, host, path, rule, verdict, n_strict, n_soft."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"(host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)})"
    when = lambda what: " ".join(f"WHEN {fits(r)} THEN {quoted(what(r))}" for r in sorted(rules, key=lambda r: -len(r.text)))

    def hits(terms: tuple[str, ...]) -> str:
        found = [f"regexp_matches(u, {quoted(('' if t[0] == '*' else '(^| )') + re.escape(t.strip('*')) + ('' if t[-1] == '*' else '( |$)'))})" for t in terms]
        return "CAST(" + " + ".join(f"{f}::INT" for f in found) + " AS BIGINT)"

    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
WITH cut AS (SELECT page_id, {low.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
       trim(regexp_replace(regexp_replace({low.format("coalesce(url, '')")}, '%[0-9a-f]{{2}}', ' ', 'g'), '{_OTHER}', ' ', 'g')) AS u FROM pages),
judged AS (SELECT *, CASE {when(lambda r: r.text)} END AS rule, CASE {when(lambda r: r.verdict)} END AS said, {hits(vocabulary.strict)} AS n_strict, {hits(vocabulary.soft)} AS n_soft FROM cut)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN n_strict > 0 OR n_soft >= {vocabulary.several} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM judged"""
