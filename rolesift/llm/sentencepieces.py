"""SentencePiece encoding by a prefix table, and decoding.

For each prefix of a text, the last token of its encoding is unique: of all
tokens that end there, just one is compatible with the last token of the prefix
before it. Two tokens are compatible if merging the characters of both side by
side gives the two again. So one pass of an Aho-Corasick automaton lists the
tokens that end at each position, pair tests pick the one that is stored, and
the ids are recovered from the end backwards. A long text costs time in
proportion to its length, however many merges it holds.

No token crosses a place whose two characters stand side by side in no piece;
texts are cut there, and before a space, so frequent parts are encoded once for
each worker (``KEPT`` parts, seen twice at least; when full it starts anew).

Each row is encoded on its own, in Arrow batches; nothing is shuffled and the
model is read by each worker. Models are of type BPE with byte fallback, identity
normalizer and a leading space; ``Model`` tries probe texts against the library
and refuses others.

Defined results: null texts are empty; an empty text is begin and end id alone;
repeated rows are encoded each; U+2581 in a text is a space, as in the library;
``encoded`` and ``decoded`` keep all other columns, and replace columns named
``ids`` or ``decoded``; ``round_trip`` does both in one pass and drops the text;
an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced

SPACE = "▁"
#: A space run and what follows, up to the next.
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Units whose ids a worker keeps, later parts of units, their longest length in characters, and the pair tests it keeps.
KEPT, TAILS, LONGEST, PAIRS = 600_000, 50_000, 40, 1_000_000
#: Rows that are held at once in their new form.
ROWS = 500
PROBES = ("", " ", "a", "  A  b\n\tc ", "Ⅸ Ａ é 中\U0001f642 don't 1234 </s><unk> ")

codecs.register_error("each byte", lambda e: ("�" * (e.end - e.start), e.end))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces of a model with their automaton, kept pair tests and kept parts."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        proc = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = (array("I", [i]).tobytes() for i in (proc.bos_id(), proc.eos_id()))
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.surface: list[bytes] = []
        self.bytes_ids = [0] * 256
        self.control: set[int] = set()
        self.inner: set[str] = set()
        self.automaton = ahocorasick.Automaton()
        for i in range(proc.get_piece_size()):
            piece = proc.id_to_piece(i)
            if proc.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_ids[value] = i
                self.surface.append(bytes([value]))
            elif proc.is_control(i):
                self.surface.append(b"")
                self.control.add(i)
            elif proc.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                self.ids[piece], self.score[piece] = i, proc.get_score(i)
                self.inner.update(piece[k : k + 2] for k in range(len(piece) - 1))
                self.automaton.add_word(piece, (len(piece), i, piece))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units, self.tails = Units(self), {}
        for text in PROBES:
            ids = array("I", proc.encode(text, add_bos=True, add_eos=True)).tobytes()
            if self.encode(text) != ids or self.decode(ids) != proc.decode(list(array("I", ids))):
                raise ValueError("not a BPE model with byte fallback, identity normalizer and leading space")

    def merged(self, text: str) -> list[str]:
        """Merges by score, best first, the leftmost of equal ones: the definition, for the length of two tokens."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, key: int, left: str, right: str) -> bool:
        """Both tokens stay as they are side by side; ``left`` is empty at the start."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = found = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def tokens(self, part: str) -> list[int]:
        """Ids of a part, all of whose neighbouring characters some piece holds side by side."""
        n = len(part)
        if n == 1:
            return [self.ids[part]] if part in self.ids else [self.bytes_ids[b] for b in part.encode()]
        # Last token of each prefix: its key in the pair tests (0 before the text) and its length.
        last, size = [0] * (n + 1), [0] * (n + 1)
        known = self.pairs.get
        end = 0
        for at, (length, token, piece) in self.automaton.iter(part):
            if at < end:
                continue
            start = at + 1 - length
            key = last[start] | token
            fits = known(key)
            if fits is None:
                fits = self.compatible(key, part[start - size[start] : start], piece)
            if fits:
                end = at + 1
                last[end], size[end] = token + 1 << 32, length
        out = []
        while n:
            out.append((last[n] >> 32) - 1)
            n -= size[n]
        return out[::-1]

    def unit(self, key: str) -> bytes:
        """Little-endian ids of a space and what follows it, cut where no piece reaches across; the first part is a unit itself."""
        unit, inner = SPACE + key, self.inner
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in inner]
        if not cuts:
            return array("I", self.tokens(unit)).tobytes()
        out = [self.units[unit[1 : cuts[0]]]]
        for a, b in zip(cuts, [*cuts[1:], len(unit)], strict=True):
            part = unit[a:b]
            ids = self.tails.get(part)
            if ids is None:
                ids = array("I", self.tokens(part)).tobytes()
                if b - a <= LONGEST:
                    if len(self.tails) >= TAILS:
                        self.tails.clear()
                    self.tails[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Begin id, the text's ids, end id."""
        if not text:
            return self.begin + self.end
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            keys = [u[1:] for u in UNIT.findall(SPACE + text.replace(" ", SPACE))]
        else:
            keys = text.split(" ")
        return b"".join([self.begin, *map(self.units.__getitem__, keys), self.end])

    def decode(self, ids: bytes) -> str:
        """The text of any ids: the first piece loses its space, bytes that are no UTF-8 become U+FFFD each."""
        numbers = memoryview(ids).cast("I").tolist()
        surfaces = list(map(self.surface.__getitem__, numbers))
        inside = 0
        while inside < len(numbers) and numbers[inside] in self.control:
            inside += 1
        if inside < len(numbers) and numbers[inside] in self.spaced:
            surfaces[inside] = surfaces[inside][1:]
        control = self.control.intersection(numbers[inside:-1])
        if control and any(x in control and surfaces[k + 1] >= b"\x80" for k, x in enumerate(numbers[:-1])):
            # No character reaches across a control piece.
            cuts = [k for k, x in enumerate(numbers) if x in self.control]
            return "".join(b"".join(surfaces[a:b]).decode("utf-8", "each byte") for a, b in zip([0, *cuts], [*cuts, len(numbers)], strict=True))
        return b"".join(surfaces).decode("utf-8", "each byte")

    @functools.cached_property
    def spaced(self) -> set[int]:
        return {i for p, i in self.ids.items() if p[0] == SPACE}


class Units(dict):
    """Ids of units, by what follows their first space; kept from the second time a unit is seen."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.seen = model, bytearray(1 << 22)

    def __missing__(self, key: str) -> bytes:
        ids = self.model.unit(key)
        if len(key) <= LONGEST:
            at = hash(key) & 0x1FFFFFF
            if self.seen[at >> 3] >> (at & 7) & 1:
                if len(self) >= KEPT:
                    self.clear()
                self[key] = ids
            else:
                self.seen[at >> 3] |= 1 << (at & 7)
        return ids


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def _with(rows: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    keep = [c for c in rows.columns if c != name]
    return keep, T.StructType([*[f for f in rows.schema if f.name != name], T.StructField(name, kind)])


def encoded(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """All columns but ``ids``, and ``ids``: the ids as little-endian unsigned 32-bit integers in a row."""
    path = path or default_model()
    keep, schema = _with(docs, "ids", T.BinaryType())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model(path).encode
        for batch in sliced(batches, ROWS):
            ids = pa.array([encode(t.as_py() or "") for t in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*keep, "ids"])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(rows, schema)


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns but ``decoded``, and ``decoded``: the text of the ids; null ids give an empty text."""
    path = path or default_model()
    keep, schema = _with(rows, "decoded", T.StringType())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model(path).decode
        for batch in sliced(batches, ROWS):
            out = pa.array([decode(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*keep, "decoded"])

    return rows.select(*keep, rows[ids].alias("_ids")).mapInArrow(texts, schema)


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``ids`` and ``decoded`` as the two operators give them, and all columns but these and the text.

    One worker and one model a task do both, and ids and texts stay there between the steps.
    """
    path = path or default_model()
    keep = [f for f in docs.schema if f.name not in (text, "ids", "decoded")]
    schema = T.StructType([*keep, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in sliced(batches, ROWS):
            ids = [own.encode(t.as_py() or "") for t in batch.columns[-1]]
            texts = [own.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=schema.names)

    return docs.select(*[f.name for f in keep], docs[text].alias("_text")).mapInArrow(rows, schema)
