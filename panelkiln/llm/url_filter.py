"""URL verdicts by host and path rules, then by a weighted vocabulary.

A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule (host and path
together, ties by text) decides. Other urls go to an Aho-Corasick automaton over the lower-cased url (A-Z): it finds all
terms with no letter or digit (ASCII) next to them, and the weights of the distinct ones are added. One strict term, or
SOFT_HITS distinct soft ones, block.

Null urls and urls without `://` have an empty host and path; a null url is allowed. Repeated rows are judged alike.
Rules and vocabulary live in each task: at most MOST_ENTRIES entries. Other columns are ignored. Terms are lower-cased
(A-Z) too; empty ones are left out, and one that is both strict and soft is strict. The lists here are a small default:
`read_vocabulary` takes a table of terms instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelkiln.llm.sparkops import bounded_rows, map_batches, table

MOST_ENTRIES = 200_000
SOFT_HITS = 2
STRICT = ("porn", "porno", "xxx", "hentai", "escort", "escorts", "camgirls", "warez", "keygen", "phishing", "malware", "viagra", "cialis")
SOFT = ("adult", "sex", "sexy", "nude", "casino", "poker", "betting", "slots", "jackpot", "gambling", "loan", "payday", "pills", "pharmacy", "crack", "torrent", "free", "cheap", "win", "bonus", "dating", "click", "track", "ads")
#: verdict, host, path
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [k for c in "/?#" if (k := rest.find(c)) >= 0]
    end = min(ends, default=len(rest))
    path = rest[end:]
    stop = min((k for c in "?#" if (k := path.find(c)) >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


class Judge:
    """Rules and vocabulary, ready for use."""

    def __init__(self, rules: list[tuple[str, str, str]], strict: list[str], soft: list[str], soft_hits: int):
        import ahocorasick

        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2], r[0])):
            self.rules.setdefault(host, []).append((path, verdict))
        self.limit = soft_hits
        self.terms = ahocorasick.Automaton()
        weights = {t.translate(_LOWER): w for terms, w in ((soft, 1), (strict, soft_hits)) for t in terms if t}
        for term, weight in weights.items():
            self.terms.add_word(term, (term, weight))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The text and verdict of the longest rule that fits."""
        best, tail = None, host
        while tail:
            for start, verdict in self.rules.get(tail, ()):
                if path.startswith(start):
                    found = (len(tail) + len(start), tail + start, verdict)
                    if best is None or found[0] > best[0]:
                        best = found
                    break
            _, _, tail = tail.partition(".")
        return best and best[1:]

    def weight(self, url: str) -> int:
        """The weights of the distinct terms that stand alone in a url."""
        text, found = url.translate(_LOWER), {}
        if len(self.terms):
            for end, (term, weight) in self.terms.iter(text):
                begin = end - len(term) + 1
                if (begin == 0 or text[begin - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                    found[term] = weight
        return sum(found.values())

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int]:
        host, path = split_url(url)
        rule, weight = self.rule(host, path), self.weight(url or "")
        verdict = rule[1] if rule else "block" if weight >= self.limit else "allow"
        return host, path, rule and rule[0], verdict, weight


def _judge_batches(rules: list, strict: list[str], soft: list[str], soft_hits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules, strict, soft, soft_hits)
        for batch in batches:
            found = [judge.judge(url) for url in batch.column(1).to_pylist()]
            columns = [pa.array([x[i] for x in found], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([x[4] for x in found], pa.int64())], ["page_id", "host", "path", "rule", "verdict", "weight"])

    return run


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """page_id, host, path, rule, verdict, weight (of distinct vocabulary terms) of each row of `pages` (page_id, url)."""
    if len(rules) + len(strict) + len(soft) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} rules and terms")
    run = _judge_batches([tuple(r) for r in rules], list(strict), list(soft), soft_hits)
    return map_batches(pages.select("page_id", "url"), run, "page_id long, host string, path string, rule string, verdict string, weight long")


def read_vocabulary(terms: DataFrame) -> tuple[list[str], list[str]]:
    """The strict and the soft terms of a table (term, strict boolean); null counts as soft, null terms are left out."""
    rows = bounded_rows(terms.where("term IS NOT NULL").select("term", "strict").distinct(), MOST_ENTRIES, "vocabulary")
    return sorted(r[0] for r in rows if r[1]), sorted(r[0] for r in rows if not r[1])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
