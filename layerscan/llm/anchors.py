"""Substring dedup by fixed-block anchors.

A passage of ``size`` words that two documents share holds a whole aligned
block of ``size // 2`` words of the first. So the blocks that do not overlap
are the index, every rolling window of that length probes it, and only around
hits the windows of ``size`` words are compared and joined to maximal repeats.

Nulls: a null text has no words; a null id comes after all others. Rows with
one id never remove each other's words. Extra columns stay out unless carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm import exchange as X
from layerscan.llm.words import Words, covered, ids_of, text_bytes, window_hashes

BLOCK, MANY = np.uint32(1), np.uint32(2)


def _short(keys: np.ndarray, n: int) -> np.ndarray:
    """Thirty bits of a key beside those that name its bucket, above two flags."""
    return (keys // np.uint64(n)).astype(np.uint32) << np.uint32(2)


def _probes(n: int, block: int):
    def question(chunk: int, table: pa.Table):
        words = Words(*text_bytes(table["text"]))
        at, keys = window_hashes(words.hashes(), words.first, block)
        if not len(at):
            return
        text = words.text_of()[at]
        order = np.argsort(keys, kind="stable")
        keys, text, aligned = keys[order], text[order], ((at - words.first[text]) % block == 0)[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        flags = np.where(np.logical_or.reduceat(aligned, new), BLOCK, np.uint32(0))
        many = np.maximum.reduceat(text, new) > np.minimum.reduceat(text, new)
        flags |= np.where(many, MANY, np.uint32(0))
        distinct = keys[new]
        yield X.send(chunk, n, distinct, _short(distinct, n) | flags)

    return question


def _hits(table: pa.Table) -> pa.Table:
    """Probes that meet a block of another document."""
    entries, row = X.unpack(table["keys"], np.uint32)
    order = np.argsort(entries >> 2, kind="stable")
    keys, flags = entries[order] >> 2, entries[order] & 3
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[new, len(keys)])
    either = np.bitwise_or.reduceat(flags, new)
    live = ((either & BLOCK) > 0) & ((sizes > 1) | ((either & MANY) > 0))
    found = np.sort(order[np.repeat(live, sizes)])
    return X.reply(table["chunk"].to_numpy(), row[found], _with_bucket(table, entries[found] >> 2))


def _with_bucket(table: pa.Table, short: np.ndarray) -> np.ndarray:
    """Bucket and thirty bits as one number."""
    return (table["bucket"][0].as_py() << 30) | short.astype(np.int64)


def _candidates(n: int, size: int, block: int):
    def question(chunk: int, table: pa.Table, got: pa.ChunkedArray):
        hits = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in got.to_pylist())])
        if not len(hits) or not table.num_rows:
            return
        words = Words(*text_bytes(table["text"]))
        hashes = words.hashes()
        at, keys = window_hashes(hashes, words.first, block)
        whole = (keys % np.uint64(n)).astype(np.int64) << 30 | (_short(keys, n) >> 2).astype(np.int64)
        live = np.zeros(len(words) + 1, np.int64)
        live[at[np.isin(whole, hits)] + 1] = 1
        live = np.cumsum(live)
        at, first = window_hashes(hashes, words.first, size)
        near = live[np.minimum(at + size - block + 1, len(words))] > live[at]
        at, first = at[near], first[near]
        if not len(at):
            return
        second = window_hashes(hashes, words.first, size, 1)[1][near]
        ids = ids_of(table["id"])[words.text_of()[at]]
        order = np.lexsort((ids, first))
        new = order[np.flatnonzero(np.r_[True, first[order][1:] != first[order][:-1]])]
        yield X.send(chunk, n, first[new], first[new], second[new].astype(np.uint32), ids[new])

    return question


def _repeats(table: pa.Table) -> pa.Table:
    """Windows that begin in a document of a smaller id, in the eyes of each chunk."""
    keys, row = X.unpack(table["keys"], np.uint64)
    counts = np.bincount(row, minlength=table.num_rows)
    seconds, ids = [], []
    for extra, count in zip(table["extra"].to_pylist(), counts):
        seconds.append(np.frombuffer(extra, np.uint32, count))
        ids.append(np.frombuffer(extra, np.int64, count, 4 * count))
    second, ids = np.concatenate(seconds), np.concatenate(ids)
    order = np.lexsort((ids, second, keys))
    k, s = keys[order], second[order]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
    least = np.repeat(ids[order][new], np.diff(np.r_[new, len(k)]))
    found = np.sort(order[ids[order] > least])
    return X.reply(table["chunk"].to_numpy(), row[found], keys[found])


def _cut(size: int, rejoin: bool):
    def work(table: pa.Table, got: pa.ChunkedArray) -> pa.Table:
        known = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in got.to_pylist())])
        data, bounds = text_bytes(table["text"])
        words = Words(data, bounds)
        at, keys = window_hashes(words.hashes(), words.first, size)
        ids = ids_of(table["id"])
        if len(at):
            mine = ids[words.text_of()[at]]
            order = np.lexsort((mine, keys))
            new = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
            least = np.empty(len(at), np.int64)
            least[order] = np.repeat(mine[order][new], np.diff(np.r_[new, len(at)]))
            at = at[(mine > least) | np.isin(keys, known)]
        gone = covered(at, size, len(words))
        kept, raw = [], data.tobytes()
        for a, b, low, high in zip(words.first[:-1], words.first[1:], bounds[:-1], bounds[1:]):
            cut = gone[a:b].any()
            parts = raw[low:high].split() if cut or rejoin else ()
            if cut:
                parts = [parts[i] for i in np.flatnonzero(~gone[a:b])]
            kept.append((b" ".join(parts) if cut or rejoin else raw[low:high]).decode())
        removed = np.diff(np.r_[0, np.cumsum(gone)][words.first])
        columns = {
            "id": table["id"],
            "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.string()),
        }
        if "rest" in table.column_names:
            columns["rest"] = table["rest"]
        return pa.table(columns)

    return work


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 50, carry: tuple[str, ...] = (),
    rejoin: bool = True,
) -> DataFrame:
    """Removes the words of every ``size``-word window that a smaller id also has.

    Returns ``id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined
    by one space) and, if any, the carried columns as the struct ``rest``. Without
    ``rejoin`` a text that loses nothing stays as it is; null becomes empty.
    """
    if size < 2:
        raise ValueError("a window has two words at least")
    block = size // 2
    n = X.sides(docs, text, 1000)
    chunks = X.chunked(docs, id_col, text, carry, n)
    hits = X.answer(X.ask(chunks, _probes(n, block)), _hits)
    repeats = X.answer(X.ask_again(chunks, hits, _candidates(n, size, block)), _repeats)
    schema = "id long, n_words long, n_removed long, kept_text string"
    if carry:
        rest = chunks.schema["rest"].dataType.simpleString()
        schema += f", rest {rest}"
    return X.finish(chunks, repeats, _cut(size, rejoin), schema)


def dedup_report(docs: DataFrame) -> DataFrame:
    """``op6``: word counts and the digest of what is kept."""
    out = substring_dedup(docs)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
