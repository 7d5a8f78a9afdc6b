"""URL filters: list rules first, then a weighted vocabulary.

One Aho-Corasick automaton finds every term of the vocabulary in host and path; a
hit counts where no letter or digit of ASCII adjoins it.  Distinct terms that hit
add their weights: a strict term alone reaches ``REJECT``, soft terms together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

REJECT = 2


def load_terms(path: str | Path) -> dict[str, int]:
    """Weights of terms from a table of two columns: strict or soft, and the term.
    The table goes to every task; it is a vocabulary kept by hand, not data."""
    rows = [line.split("\t") for line in Path(path).read_text(encoding="utf-8").splitlines() if line]
    return {term: REJECT if kind == "strict" else 1 for kind, term in rows}


def load_rules(path: str | Path) -> tuple[tuple[str, str, str], ...]:
    """(verdict, host, path) from a table of these columns."""
    return tuple(tuple(line.split("\t")) for line in Path(path).read_text(encoding="utf-8").splitlines() if line)


WEIGHTS = load_terms(Path(__file__).with_name("url_terms.tsv"))
RULES = load_rules(Path(__file__).with_name("url_rules.tsv"))


class Rules:
    """A trie of host labels from the last to the first; a node has the paths of its
    rules, by length."""

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node.setdefault("", {}).setdefault(len(path), {})[path] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule, in all its characters, whose host is
        this one or a parent of it and whose path starts this one."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label) if label else None
            if node is None:
                break
            for size, paths in node.get("", {}).items():
                found = paths.get(path[:size]) if size <= len(path) else None
                if found and (best is None or len(found[0]) > len(best[0])):
                    best = found
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_lower), path


_lower = {c: c + 32 for c in range(65, 91)}


@cache
def _automaton(terms: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in terms:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def _inner(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isascii() and text[i].isalnum())


def hits(text: str, terms: tuple[tuple[str, int], ...]) -> dict[str, int]:
    """Terms with a hit that no letter or digit adjoins, with their weights."""
    found = {}
    for last, (term, weight) in _automaton(terms).iter(text):
        if not _inner(text, last + 1) and not _inner(text, last - len(term)):
            found[term] = weight
    return found


def judge(pages: DataFrame, rules=RULES, weights: dict[str, int] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (null where none fits), weight (of the distinct
    terms that hit host and path, A-Z lower-cased) and verdict: the rule's, else
    block from a weight of ``REJECT`` on, else allow.

    One row for each row, null ids and repeated rows included; whole urls are read,
    however long; other columns are not.  A null url or one without '://'
    has an empty host and path, no rule and no hit: it is allowed.
    """
    terms = tuple(sorted((WEIGHTS if weights is None else weights).items()))
    known = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.small(batches, "url"):
            out = ([], [], [], [], [])
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                weight = sum(hits(f"{host}{path}".translate(_lower), terms).values())
                rule = known.find(host, path)
                verdict = rule[1] if rule else "block" if weight >= REJECT else "allow"
                for column, x in zip(out, (host, path, rule and rule[0], weight, verdict)):
                    column.append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *map(pa.array, out, kinds)], names=["page_id", "host", "path", "rule", "weight", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, weight long, verdict string")
