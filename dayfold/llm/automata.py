"""Removal of repeated word windows by suffix automata of reference shards.

A reference shard is what stands earlier in the corpus; a later text is streamed through its automaton, and
the matching statistic (the longest run of words ending here that the shard contains) shows the windows that
the shard has. The shards grow with the corpus, so they are not broadcast whole: windows that can match are
brought together by their trigger (`phrases.py`), and each trigger's phrases, in corpus order, are streamed
through the automaton of those before and then added to it. Phrases equal to an earlier one, and phrases
whose words around the trigger occur nowhere else, are decided before that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from dayfold.llm.common import documents
from dayfold.llm.phrases import Kind, Records, entangled, numbered, owner_spans, range_hashes, without_repeats, word_units

WINDOW = 20
GRAM = 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """All word sequences of the texts added so far."""

    def __init__(self) -> None:
        self.after: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _new(self, length: int, link: int, after: dict) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A state for the shorter sequences of q that end a longer one of p."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.after[q]))
        self.link[q] = clone
        while p >= 0 and self.after[p].get(word) == q:
            self.after[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            q = self.after[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            state, p = self._new(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.after[p]:
                self.after[p][word] = state
                p = self.link[p]
            if p >= 0:
                q = self.after[p][word]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = state

    def matches(self, words: list[bytes]) -> list[int]:
        """For each word the length of the longest sequence ending there that the texts contain."""
        state = length = 0
        found = []
        for word in words:
            while state and word not in self.after[state]:
                state = self.link[state]
                length = self.length[state]
            after = self.after[state].get(word)
            if after is None:
                state = length = 0
            else:
                state, length = after, length + 1
            found.append(length)
        return found


def earlier_anywhere(records: Records, kind: Kind) -> list[np.ndarray]:
    """Spans (doc, version, begin, end), in words, of the windows that also start earlier in the corpus."""
    if not len(records.doc):
        return [records.doc, records.version, records.start, records.start]
    number, flat, offsets = numbered(records.data, records.size)
    units = word_units(flat, offsets)
    first, spans, _ = owner_spans(records, number, units.sizes - kind.window + 1, kind)
    shift = records.shift[first]
    some = np.flatnonzero(entangled(units, shift, kind))
    if not len(some):
        return spans
    trigger = (np.cumsum(units.sizes) - units.sizes + shift)[some]
    trigger = range_hashes(units.codes, trigger, trigger + kind.gram)
    owner = first[some]
    order = np.lexsort((records.start[owner], records.version[owner], records.doc[owner], trigger))
    data = flat.tobytes()
    rows, begins, ends, last, shard = [], [], [], None, SuffixAutomaton()
    for i in order.tolist():
        if trigger[i] != last:
            last, shard = trigger[i], SuffixAutomaton()
        words = data[offsets[some[i]]:offsets[some[i] + 1]].split(b" ")
        begin = -1
        for j, n in enumerate([*shard.matches(words), 0]):
            if n >= kind.window and begin < 0:
                begin = j - kind.window + 1
            elif n < kind.window and begin >= 0:
                rows.append(owner[i])
                begins.append(begin)
                ends.append(j)
                begin = -1
        shard.add(words)
    row = np.array(rows, np.int64)
    start = records.start[row]
    found = [records.doc[row], records.version[row], start + np.array(begins, np.int64), start + np.array(ends, np.int64)]
    return [np.concatenate(x) for x in zip(spans, found)]


KIND = Kind(WINDOW, GRAM, True, earlier_anywhere)


def _results(id_col: str, text_col: str):
    def finish(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
        rows = []
        for text, spans in zip(batch.column(text_col), found):
            words = WORD.findall((text.as_py() or "").encode())
            n = len(words)
            places = [] if spans is None else list(zip(spans[0].tolist(), spans[1].tolist()))
            for a, b in reversed(places):
                del words[a:b]
            rows.append((n, n - len(words), [{"begin": a, "end": b} for a, b in places], hashlib.sha256(b" ".join(words)).hexdigest()))
        n, removed, spans, digest = zip(*rows) if rows else ((),) * 4
        columns = [
            pc.cast(batch.column(id_col), pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(digest, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"])

    return finish


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans removed (word places), kept_sha256.

    A word goes if a window of `WINDOW` words over it also starts earlier: in a document with a smaller id,
    or earlier in the same one. Null ids rank behind all others; a null or empty text has no words; rows that
    are equal in id and text have equal results.
    """
    schema = "doc_id long, n_words long, n_removed long, spans array<struct<begin: bigint, end: bigint>>, kept_sha256 string"
    return without_repeats(docs.select(id_col, text_col), KIND, _results(id_col, text_col), schema, id_col, text_col)


def op5_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_ORACLE = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM places),
firsts AS (SELECT s, min((doc_id, i)) AS f FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE f <> (doc_id, i)),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM hits, range(0, 20) r(o)),
words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM docs)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN (
    SELECT doc_id, count(*) AS n, string_agg(words.w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
) k USING (doc_id)
"""
