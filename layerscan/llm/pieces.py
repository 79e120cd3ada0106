"""SentencePiece encoding and decoding by a max-plus scan over chunks.

Merging pairs by score gives, of all ways to cut a text into pieces, the one in
which every two neighbours are what merging makes of their own characters. So
encoding is a best path: an edge weighs 0 if its piece may follow the piece
before it and minus infinity if not. A prefix has one such path at most, so one
piece per position says it all, or a search from the left if only the path to
the end is asked for.

A document of more than ``CHUNK`` characters is cut into chunks. The state at a
cut is the piece that reaches or crosses it; each chunk gives the matrix of
weights from the states at its start to those at its end, the matrices of a
document are multiplied in max-plus algebra from both ends to name the state at
every cut, and each chunk is then traced back alone. A cut at a place that no
piece crosses has one state. Shorter documents are one chunk and need no other.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerscan.llm.vocabulary import PIECE_MODEL, SPACE_MARK, read_pieces
from layerscan.llm.words import kept_model, trimmed
from layerscan.session import materialize

CHUNK = 32_768
#: Bytes of remembered stretches between spaces, of which a Python worker keeps two turns.
MEMORY = 24 << 20
#: What a remembered stretch takes besides its characters and ids, about.
ENTRY_BYTES = 200
#: Remembered pairs of neighbours.
PAIRS = 300_000
#: Characters of which the pieces that begin with them are remembered, and remembered ones.
HEAD, HEADS = 4, 50_000
OUT_BYTES = 8 << 20
NO = -np.inf


class Encoder:
    """Pieces of texts under one vocabulary; remembers stretches between spaces."""

    def __init__(self, vocabulary: dict):
        self.pieces: dict[str, tuple[int, float]] = vocabulary["pieces"]
        self.longest = max(map(len, self.pieces), default=1)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) or ("\n" in p and p != "\n") for p in self.pieces):
            raise ValueError("pieces must not run across spaces or lines")
        self.bytes, self.unknown = vocabulary["bytes"], vocabulary["unknown"]
        self.stretch = re.compile(f"[ {SPACE_MARK}]*[^ {SPACE_MARK}\n]+|[ {SPACE_MARK}]+|\n")
        self.score = {p: s for p, (_, s) in self.pieces.items()}
        self.options = {p: (len(p), p, i, {}) for p, (i, _) in self.pieces.items()}
        self.strange: dict[str, tuple] = {}
        self.n_follows = 0
        self.edges: dict[str, tuple | None] = {}
        self.heads: dict[str, tuple] = {}
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.older: dict[str, bytes] = {}
        self.text_of = {i: p for p, (i, _) in self.pieces.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.tree: dict = {}
        for piece in self.pieces:
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = self.options[piece]
        self.plain = {i: p.replace(SPACE_MARK, " ") for i, p in self.text_of.items()}
        self.plain |= {i: chr(b) for i, b in self.byte_of.items() if b < 128}

    def merged(self, text: str, scores: list[float] | None = None) -> list[str]:
        """Pieces by merging: always the best pair, the first of equals. ``scores`` takes those of the merges."""
        parts, score = list(text), self.score.get
        values = [score(x + y, NO) for x, y in zip(parts, parts[1:])]
        while values and (best := max(values)) > NO:
            at = values.index(best)
            if scores is not None:
                scores.append(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]
            if at:
                values[at - 1] = score(parts[at - 1] + parts[at], NO)
            if at < len(values):
                values[at] = score(parts[at] + parts[at + 1], NO)
        return parts

    def _edges(self, piece: str) -> tuple | None:
        """First and last parts of a piece while it is merged, each with the score of the merge
        that takes it up, and whether scores only fall; None if merging does not make the piece."""
        scores: list[float] = []
        if self.merged(piece, scores) != [piece]:
            return None
        falls = all(x >= y for x, y in zip(scores, scores[1:]))
        parts, score, first, last = list(piece), self.score.get, [], []
        for best in scores:
            at = next(i for i, (x, y) in enumerate(zip(parts, parts[1:])) if score(x + y, NO) == best)
            if at == 0:
                first.append((parts[0], best))
            if at == len(parts) - 2:
                last.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [*first, (piece, NO)], [*last, (piece, NO)], falls

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether merging leaves the two pieces as they are.

        Each side merges as it does alone until a pair across the place between
        them is the best. Where the scores of both only fall, that pair is the best
        if it is better than the next merges of its two parts; of equals the first goes.
        """
        known = self.edges
        for piece in (left, right):
            if piece not in known:
                if len(known) >= PAIRS:
                    known.clear()
                known[piece] = self._edges(piece)
        one, two = known[left] if left in known else self._edges(left), known[right]
        if one is None or two is None:
            return False
        if not (one[2] and two[2]):
            return self.merged(left + right) == [left, right]
        one, two, score, i, j = one[1], two[0], self.score.get, 0, 0
        while True:
            (x, next_x), (y, next_y) = one[i], two[j]
            across = score(x + y, NO)
            if across > next_x and across >= next_y:
                return False
            if next_x >= next_y:
                if next_x == NO:
                    return True
                i += 1
            else:
                j += 1

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging leaves the two pieces as they are, remembered for some pairs."""
        one, two = self._option(left), self._option(right)
        found = one[3].get(two[2])
        return self._found(one, two) if found is None else found

    def _found(self, one: tuple, two: tuple) -> bool:
        """``may_follow`` of two options, which is then remembered."""
        if self.n_follows >= PAIRS:
            for option in (*self.options.values(), *self.strange.values()):
                option[3].clear()
            self.strange.clear()
            self.heads.clear()
            self.n_follows = 0
        found = one[3][two[2]] = self._stay_apart(one[1], two[1])
        self.n_follows += 1
        return found

    def _option(self, piece: str) -> tuple:
        """Length, piece, its name and what may follow it by name; a character without a piece is its own name."""
        option = self.options.get(piece) or self.strange.get(piece)
        if option is None:
            if len(self.strange) >= HEADS:
                self.strange.clear()
                self.heads.clear()
            option = self.strange[piece] = (len(piece), piece, piece, {})
        return option

    def path(self, text: str, begin: int, before: str | None, stop: int, end: int) -> list[int]:
        """Length of the last piece of the path to each position from ``begin`` to
        ``end``, 0 where there is none; no piece starts at ``stop`` or later.

        ``before`` is the piece that ends at ``begin``; None if any may follow.
        """
        size = [0] * (end - begin + 1)
        pieces, longest = self.pieces, self.longest
        for i in range(begin + 1, end + 1):
            for n in range(min(longest, i - begin), 0, -1):
                j = i - n
                if j >= stop or (j > begin and not size[j - begin]):
                    continue
                piece = text[j:i]
                if n > 1 and piece not in pieces:
                    continue
                left = before if j == begin else text[j - size[j - begin] : j]
                if left is None or self.may_follow(left, piece):
                    size[i - begin] = n
                    break
        return size

    def _options(self, text: str, at: int) -> tuple:
        """Options of the pieces that start at a place, and of its character, in descending order of length."""
        head = text[at : at + HEAD]
        found = self.heads.get(head)
        if found is None:
            node, options = self.tree.get(head[0]), [self._option(head[0])]
            for c in head[1:]:
                node = node and node.get(c)
                if node and "" in node:
                    options.append(node[""])
            if len(self.heads) >= HEADS:
                self.heads.clear()
            found = self.heads[head] = tuple(options[::-1]), node if node and len(node) > ("" in node) else None
        options, node = found
        if node is None:
            return options
        more, i, size = [], at + len(head), len(text)
        while node and i < size:
            node = node.get(text[i])
            i += 1
            if node and "" in node:
                more.append(node[""])
        return (*more[::-1], *options) if more else options

    def search(self, text: str) -> list[tuple]:
        """Options of the path from end to end, longest pieces first, taking back what leads nowhere.

        A prefix has one path, so a place that once led nowhere never does.
        """
        # Most texts need nothing taken back.
        at, out, after, size, heads = 0, [], None, len(text), self.heads
        while at < size:
            options = heads.get(text[at : at + HEAD])
            options = options[0] if options and options[1] is None else self._options(text, at)
            for option in options:
                if after is None:
                    break
                may = after.get(option[2])
                if may is None:
                    may = self._found(out[-1], option)
                if may:
                    break
            else:
                return self._searched(text)
            out.append(option)
            at += option[0]
            after = option[3]
        return out

    def _searched(self, text: str) -> list[tuple]:
        at, out, dead, size = 0, [], set(), len(text)
        left = [iter(self._options(text, 0))]
        while at < size:
            for option in left[-1]:
                end = at + option[0]
                if end in dead:
                    continue
                if out:
                    may = out[-1][3].get(option[2])
                    if may is None:
                        may = self._found(out[-1], option)
                    if not may:
                        continue
                out.append(option)
                at = end
                if at < size:
                    left.append(iter(self._options(text, at)))
                break
            else:
                dead.add(at)
                left.pop()
                at -= out.pop()[0]
        return out

    def walk(self, text: str, begin: int, size: list[int], end: int) -> list[str]:
        """The pieces of the path that ends at ``end``."""
        out = []
        while end > begin:
            n = size[end - begin]
            out.append(text[end - n : end])
            end -= n
        return out[::-1]

    def ids(self, parts: list[str]) -> bytes:
        """Ids of pieces as packed numbers; a character without a piece becomes bytes."""
        out = []
        for part in parts:
            piece = self.pieces.get(part)
            if piece is not None:
                out.append(piece[0])
            elif self.bytes:
                out.extend(self.bytes[b] for b in part.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids of a text that begins with a space; a space mark is one, too."""
        stretches = self.stretch.findall(text)
        out = list(map(self.known.get, stretches))
        if None in out:
            for i, packed in enumerate(out):
                if packed is None:
                    out[i] = self._pieces_of(stretches[i])
        return b"".join(out)

    def _pieces_of(self, stretch: str) -> bytes:
        """Packed ids of a stretch, remembered for two turns of MEMORY bytes."""
        packed = self.older.get(stretch)
        if packed is None:
            found = self.search(stretch.replace(" ", SPACE_MARK))
            try:
                packed = array("i", [option[2] for option in found]).tobytes()
            except TypeError:  # Of a character without a piece.
                packed = self.ids([option[1] for option in found])
        if len(stretch) < 64:
            if self.known_bytes >= MEMORY:
                self.known, self.older, self.known_bytes = {}, self.known, 0
            self.known[stretch] = packed
            self.known_bytes += ENTRY_BYTES + 2 * len(stretch) + len(packed)
        return packed

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no character become replacement characters."""
        plain = self.plain
        try:
            text = "".join([plain[i] for i in ids])
        except KeyError:
            raw = b"".join(
                bytes([self.byte_of[i]]) if i in self.byte_of else plain.get(i, " ⁇ ").encode() for i in ids
            )
            text = raw.decode(errors="replace")
        return text[1:] if text.startswith(" ") else text

    # Chunks of a long document. ``text`` is the chunk with up to ``longest``
    # characters of its neighbours, ``a`` and ``b`` are its cuts within that.

    def open_at(self, text: str, at: int) -> bool:
        """Whether no piece crosses or ties the place: ends, lines, and before spaces."""
        if at == 0 or at == len(text) or "\n" in (text[at - 1], text[at]):
            return True
        return text[at] == SPACE_MARK and text[at - 1] != SPACE_MARK

    def states(self, text: str, at: int) -> list[tuple[int, str]]:
        """The pieces that may reach or cross a cut, as end and piece."""
        if self.open_at(text, at):
            return [(at, "")]
        found = []
        for j in range(max(0, at - self.longest), at):
            for i in range(at, min(len(text), j + self.longest) + 1):
                if i - j == 1 or text[j:i] in self.pieces:
                    found.append((i, text[j:i]))
        return found

    def _open(self, text: str, places: range) -> int | None:
        return next((i for i in places if self.open_at(text, i)), None)

    def matrix(self, text: str, a: int, b: int) -> np.ndarray:
        """Weights from the states at ``a`` to the states at ``b``."""
        entry, exit_ = self.states(text, a), self.states(text, b)
        end = max(i for i, _ in exit_)
        first, last = self._open(text, range(a, b + 1)), self._open(text, range(b, a - 1, -1))
        tail = None if last is None else self.path(text, last, None, b, end)
        out = np.full((len(entry), len(exit_)), NO)
        for row, (begin, before) in enumerate(entry):
            origin, size = last, tail
            if first is None:
                origin, size = begin, self.path(text, begin, before or None, b, end)
            elif begin > first or (begin < first and not self.path(text, begin, before, first, first)[-1]):
                continue
            for column, (i, piece) in enumerate(exit_):
                same = first is None and (i, piece) == (begin, before)
                if not piece:
                    ok = i == origin or (i > origin and size[i - origin] > 0)
                else:
                    ok = same or (i > origin and size[i - origin] == len(piece) and i - len(piece) >= a)
                if ok:
                    out[row, column] = 0.0
        return out

    def trace(self, text: str, a: int, b: int, enter: int, leave: int) -> bytes:
        """Packed ids of the pieces that start in the chunk, for given states."""
        (begin, before), (end, _) = self.states(text, a)[enter], self.states(text, b)[leave]
        first, last = self._open(text, range(a, b + 1)), self._open(text, range(b, a - 1, -1))
        if first is None:
            return self.ids(self.walk(text, begin, self.path(text, begin, before or None, b, end), end))
        head = self.path(text, begin, before or None, first, first)
        tail = self.path(text, last, None, b, end)
        return (
            self.ids(self.walk(text, begin, head, first))
            + self.encode(text[first:last])
            + self.ids(self.walk(text, last, tail, end))
        )


def times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Product in max-plus algebra."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def _encoder(vocabulary: dict) -> Encoder:
    """The worker's encoder for a broadcast vocabulary."""
    return kept_model("encoder", vocabulary, lambda: Encoder(vocabulary))


def _marked(text: str) -> str:
    return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in packed])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _split(chunk: int, margin: int):
    def run(batches):
        for batch in batches:
            for uid, text in zip(batch.column("uid"), batch.column("text")):
                text = _marked(text.as_py())
                count = -(-len(text) // chunk)
                for j in range(count):
                    a, b = j * chunk, min((j + 1) * chunk, len(text))
                    low, high = max(0, a - margin), min(len(text), b + margin)
                    # An end of the document is an open cut; elsewhere one more character shows.
                    yield pa.RecordBatch.from_pydict(
                        {"uid": [uid.as_py()], "chunk": [j], "part": [text[low:high]], "a": [a - low], "b": [b - low]},
                        schema=pa.schema([("uid", pa.int64()), ("chunk", pa.int64()), ("part", pa.string()), ("a", pa.int64()), ("b", pa.int64())]),
                    )

    return run


def _matrices(shared):
    def run(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            made = [encoder.matrix(t, a, b) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("chunk"), pa.array([len(m) for m in made], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())],
                names=["uid", "chunk", "n", "matrix"],
            )

    return run


def _choose(table):
    """State at each cut of a document: the one on a path of weight 0 from end to end."""
    table = table.sort_by("chunk")
    made = [np.frombuffer(m, np.float64).reshape(n, -1) for m, n in zip(table["matrix"].to_pylist(), table["n"].to_pylist())]
    ahead = [np.zeros((1, 1))]
    for m in made:
        ahead.append(times(ahead[-1], m))
    behind = np.zeros((made[-1].shape[1], 1))
    at = [int(behind.argmax())]
    for m, row in zip(made[::-1], ahead[-2::-1]):
        # Of the states reached from the start, one leads on to the state chosen next.
        at.append(int((row[0] + m[:, at[-1]]).argmax()))
    at = at[::-1]
    return pa.table({"uid": table["uid"], "chunk": table["chunk"], "enter": pa.array(at[:-1], pa.int64()), "leave": pa.array(at[1:], pa.int64())})


def _traced(shared):
    def run(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "a", "b", "enter", "leave"))
            packed = [encoder.trace(*row) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("chunk"), _lists(packed)], names=["uid", "chunk", "ids"])

    return run


def _encode_long(long: DataFrame, shared, margin: int, chunk: int) -> DataFrame:
    """``uid`` and ``ids`` of rows that are cut into chunks."""
    parts = materialize(
        long.select("uid", "text")
        .mapInArrow(_split(chunk, margin), "uid long, chunk long, part string, a long, b long")
        .repartition("uid", "chunk"),
        "parts",
    )
    matrices = parts.mapInArrow(trimmed(_matrices(shared)), "uid long, chunk long, n long, matrix binary")
    states = matrices.groupBy("uid").applyInArrow(_choose, "uid long, chunk long, enter long, leave long")
    traced = parts.join(states, ["uid", "chunk"]).mapInArrow(trimmed(_traced(shared)), "uid long, chunk long, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return traced.groupBy("uid").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def encode(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = PIECE_MODEL,
    carry: tuple[str, ...] = (), chunk: int = CHUNK,
) -> DataFrame:
    """``id``, ``ids`` and ``decoded`` of each row, and carried columns as ``rest``.

    ``ids`` are those of the SentencePiece library; ``decoded`` is made from
    them. A null text has null for both; an empty text has no ids and decodes
    to the empty text.
    """
    vocabulary = read_pieces(model)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    margin = 2 * max(map(len, vocabulary["pieces"]), default=1)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), *(F.struct(*carry).alias("rest") for _ in carry[:1])
    )
    extra = f", rest {rows.schema['rest'].dataType.simpleString()}" if carry else ""
    extra_names = ["rest"] if carry else []

    def short(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            a, packed, decoded, size = 0, [], [], 0
            for i, value in enumerate(batch.column("text")):
                value = value.as_py()
                ids = None if value is None else encoder.encode(" " + value if value else "")
                packed.append(ids)
                decoded.append(None if ids is None else encoder.decode(np.frombuffer(ids, np.int32).tolist()))
                size += len(ids or b"")
                if size > OUT_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(a, i + 1 - a)
                    lists = _lists([x or b"" for x in packed])
                    nulls = pa.array([x is None for x in packed])
                    lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=nulls)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), lists, pa.array(decoded, pa.string()), *(part.column(c) for c in extra_names)],
                        names=["id", "ids", "decoded", *extra_names],
                    )
                    a, packed, decoded, size = i + 1, [], [], 0

    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    done = rows.where(~is_long).mapInArrow(trimmed(short), f"id long, ids array<int>, decoded string{extra}")
    long = materialize(rows.where(is_long).withColumn("uid", F.monotonically_increasing_id()), "long")
    whole = _encode_long(long, shared, margin, chunk)
    told = long.select("uid", "id", *extra_names).join(whole, "uid")
    return done.unionByName(_decoded(told, shared, extra_names, extra))


def _decoded(encoded: DataFrame, shared, keep: list[str], extra: str) -> DataFrame:
    def run(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else encoder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("ids"), pa.array(texts, pa.string()), *(batch.column(c) for c in keep)],
                names=["id", "ids", "decoded", *keep],
            )

    return encoded.select("id", "ids", *keep).mapInArrow(trimmed(run), f"id long, ids array<int>, decoded string{extra}")


def decode(encoded: DataFrame, model: str = PIECE_MODEL) -> DataFrame:
    """``id``, ``ids`` and the text ``decoded`` of rows with ``id`` and ``ids``; null stays null."""
    return _decoded(encoded, encoded.sparkSession.sparkContext.broadcast(read_pieces(model)), [], "")


def piece_report(docs: DataFrame) -> DataFrame:
    """``op2``: ids of each document, their number, and the digest of their text."""
    out = encode(docs)
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )
