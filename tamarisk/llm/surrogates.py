"""Problem 8, second half: what stands in place of the personal data that ``pii`` finds: placeholders of its kind, or keyed surrogates.

Each entity falls into units (name parts, words of an address, labels of an email, the digits of a number). A unit's surrogate comes
from a keyed permutation of all texts of its format, letter for letter and digit for digit, vowels for vowels, in the same script.
A permutation gives different units different surrogates and one unit always the same, so that mentions of one person or number
stay recognisable as one and those of two stay two, without a table of all units, however many there are; and it is made so that no
unit is its own surrogate. Gender: titles stay, and so does a final a, e or o, which carries it in most European languages; case,
separators and order of each mention stay as written. A house number is drawn within its street, an extension within its number.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import pii

#: Letters that stand for each other; no letter is in two of them. Others stand for their like in their part of the code table.
POOLS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöøùúûü", "çñ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "اوي", "بتثجحخدذرزسشصضطظعغفقكلمنه", "אבגדהוזחטיכלמנסעפצקרשת")
_POOL_OF = {c: p for p in POOLS for c in p}
#: Final vowels that carry gender and stay, and those that stand for each other at the end of a word.
ENDINGS, OTHER_ENDINGS = "aeo", "iu"

# Words of an entity that tell its type and stay.
KEPT = frozenset("at arroba dot punto mailto tel ext test example com org net mail post info north south east west old new street st road rd lane ln avenue ave boulevard blvd court ct close drive way place pl square sq terrace crescent alley apt flat unit suite room calle avenida av avda pje pasaje paseo plaza piso depto n º c rue bis ter chemin de del des du la las los le les ул улица проспект д кв дом кв".split())


class Unit(NamedTuple):
    """A part of an entity that is replaced: where it stands there, its folded characters, and what it is drawn within."""

    start: int
    end: int
    text: str
    within: str


class Entity(NamedTuple):
    """A found entity and what may stand for it; offsets count code points from 0."""

    kind: str
    start: int
    end: int
    placeholder: str
    surrogate: str
    units: tuple[str, ...]
    drawn: tuple[str, ...]


def _fold(s: str) -> str:
    return unicodedata.normalize("NFKC", s).casefold()


def units_of(kind: str, entity: str) -> list[Unit]:
    """What is replaced in an entity. The digits of a number are one unit, those of its extension another."""
    if kind in ("phone", "id_number"):
        at = [i for i, c in enumerate(entity) if c.isalnum()]
        if kind == "id_number":
            groups = [at]
        else:
            cut = re.search(r"(?i)(?<=[\d \u00a0])(?:ext|x|int|доб)", entity)
            digits = [i for i in at if entity[i].isdigit()]
            groups = [[i for i in digits if not cut or i < cut.start()], [i for i in digits if cut and i >= cut.start()]]
        out: list[Unit] = []
        for g in filter(None, groups):
            out.append(Unit(g[0], g[-1] + 1, _fold("".join(entity[i] for i in g)), out[0].text if out else ""))
        return out
    words = [m for m in re.finditer(r"[^\W\d_]+|\d+", entity) if m.group().lower() not in KEPT]
    street = ""
    if kind == "address":
        main = entity.find(",", entity.find(",") + 1 if entity[: entity.find(",")].strip().isdigit() else 0)
        street = " ".join(_fold(m.group()) for m in words if not m.group()[0].isdigit() and (main < 0 or m.start() < main))
    return [Unit(m.start(), m.end(), _fold(m.group()), street if m.group()[0].isdigit() else "") for m in words]


@lru_cache(maxsize=10_000)
def _pool(c: str) -> str:
    """The characters that may stand for ``c``, itself among them; the same for all of them."""
    value = unicodedata.decimal(c, None)
    if value is not None:
        return "".join(chr(ord(c) - value + k) for k in range(10))
    if c in _POOL_OF:
        return _POOL_OF[c]
    if not c.isalpha() or _fold(c) != c:
        return c
    kind, start = unicodedata.category(c), ord(c) // 64 * 64
    return "".join(x for x in map(chr, range(start, start + 64)) if x.isalpha() and unicodedata.category(x) == kind and _fold(x) == x and x not in _POOL_OF)


@lru_cache(maxsize=200_000)
def draw(key: str, unit: str, within: str = "") -> str:
    """The surrogate of a unit: as long and of the same classes of characters, never the unit itself, and different for different units.

    One character is moved by one to m - 1 places in its pool of m, as a keyed hash of the others says; then each other one as a hash of the moved one and of those
    before it says. Both steps can be undone, so that no two units of a format meet; a surrogate has its unit's format, so that
    none of two formats do. A unit none of whose characters has a like becomes the letters of a keyed hash.
    """
    pools = [_pool(c) for c in unit]
    if len(unit) > 1 and unit[-1] in POOLS[0]:
        pools[-1] = unit[-1] if unit[-1] in ENDINGS else OTHER_ENDINGS
    first = next((i for i, p in enumerate(pools) if len(p) > 1), None)
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    made = "\x1f".join(["".join(p[0] for p in pools), within])
    whole = hashlib.blake2b(f"{made}\x1f{unit if first is None else unit[:first] + unit[first + 1 :]}".encode(), key=secret, digest_size=16)
    if first is None:
        return "".join(chr(ord("a") + x % 16) for x in whole.digest())
    out = list(unit)
    m = len(pools[first])
    out[first] = pools[first][(pools[first].index(unit[first]) + 1 + int.from_bytes(whole.digest(), "big") % (m - 1)) % m]
    chain = hashlib.blake2b(f"{made}\x1f{out[first]}".encode(), key=secret, digest_size=8)
    for i, c in enumerate(unit):
        if i != first:
            p = pools[i]
            if len(p) > 1:
                out[i] = p[(p.index(c) + int.from_bytes(chain.digest(), "big")) % len(p)]
            chain.update(c.encode())
    return "".join(out)


def dress(text: str, drawn: str) -> str:
    """The drawn characters in the case, digits and separators of the text they replace; more of them than it has follow at the end."""
    out, it = [], iter(drawn)
    for c in text:
        if not c.isalnum():
            out.append(c)
            continue
        d = next(it, "")
        if "０" <= c <= "９" and d.isascii() and d.isdigit():
            d = chr(ord("０") + int(d))
        out.append(d.upper() if c.isupper() else d)
    return "".join([*out, *it])


def entities(text: str | None, known: frozenset[str], key: str) -> list[Entity]:
    """The personal data of a text in order, each with its placeholder and its surrogate."""
    out = []
    for sp in pii.find_spans(text, known):
        whole = text[sp.start : sp.end]
        units = units_of(sp.kind, whole)
        drawn = [draw(key, u.text, u.within) for u in units]
        parts, at = [], 0
        for u, d in zip(units, drawn):
            parts += [whole[at : u.start], dress(whole[u.start : u.end], d)]
            at = u.end
        out.append(Entity(sp.kind, sp.start, sp.end, f"[{sp.kind.upper()}]", "".join([*parts, whole[at:]]), tuple(f"{u.text}@{u.within}" for u in units), tuple(drawn)))
    return out


def rewritten(text: str | None, found: list[Entity], by: str) -> str | None:
    """The text with the ``placeholder`` or ``surrogate`` of each of its entities."""
    if not found:
        return text
    parts, at = [], 0
    for e in found:
        parts += [text[at : e.start], getattr(e, by)]
        at = e.end
    return "".join([*parts, text[at:]])


def untouched(text: str, found: list[Entity], new: str, by: str) -> bool:
    """What stands outside the entities is in the new text, in its place and nothing else."""
    at = old = 0
    for e in found:
        piece = text[old : e.start]
        if not new.startswith(piece, at):
            return False
        at, old = at + len(piece) + len(getattr(e, by)), e.end
    return new[at:] == text[old:]


def _per_text(docs: DataFrame, names: DataFrame, secret: str, key: str, text: str, out: Callable[[list, list, list[list[Entity]]], dict[str, pa.Array]], schema: str) -> DataFrame:
    """A narrow map: ``out`` makes columns from the keys, the texts and the entities of an Arrow batch."""
    known = docs.sparkSession.sparkContext.broadcast(pii.name_parts(names))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            columns = out(b.column(0), texts, [entities(t, known.value, secret) for t in texts])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select(F.col(key).alias("__key"), F.col(text)).mapInArrow(run, f"__key {kind}, {schema}").withColumnRenamed("__key", key)


def find_entities(docs: DataFrame, names: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, kind, start_char, end_char (from 1, both included, in code points), entity, placeholder and surrogate, one row for each occurrence.

    Also units and drawn, the parts of entity and surrogate that ``check_distinct`` compares. Null and empty texts hold none; copies of a
    text are searched like any other. ``names`` lists name parts (column ``name``). Other columns are ignored; whole texts are
    searched. The same ``secret`` gives the same surrogates. A narrow map: no shuffle, no table of units.
    """

    def rows(keys: pa.Array, texts: list, found: list[list[Entity]]) -> dict[str, pa.Array]:
        at = [i for i, es in enumerate(found) for _ in es]
        es = [e for x in found for e in x]
        text_of = lambda values: pa.array(list(values), pa.string())
        return {
            "__key": keys.take(pa.array(at, pa.int64())), "kind": text_of(e.kind for e in es), "start_char": pa.array([e.start + 1 for e in es], pa.int32()), "end_char": pa.array([e.end for e in es], pa.int32()),
            "entity": text_of(texts[i][e.start : e.end] for i, e in zip(at, es)), "placeholder": text_of(e.placeholder for e in es), "surrogate": text_of(e.surrogate for e in es), "units": text_of("\x1f".join(e.units) for e in es), "drawn": text_of("\x1f".join(e.drawn) for e in es),
        }

    return _per_text(docs, names, secret, key, text, rows, "kind string, start_char int, end_char int, entity string, placeholder string, surrogate string, units string, drawn string")


def replace_entities(docs: DataFrame, names: DataFrame, secret: str, by: str = "surrogate", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the text with a surrogate (``by="placeholder"``: a typed placeholder) for each occurrence of personal data, all else untouched.

    Null and empty texts stay as they are; copies of a text and repeated rows come out alike, one row for each row given. A narrow
    map over whole texts.
    """

    def rows(keys: pa.Array, texts: list, found: list[list[Entity]]) -> dict[str, pa.Array]:
        return {"__key": keys, "text": pa.array([rewritten(t, es, by) for t, es in zip(texts, found)], pa.string())}

    return _per_text(docs, names, secret, key, text, rows, "text string")


def check_replaced(docs: DataFrame, names: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, untouched and changed for each document: whether both rewritten texts hold what is outside the entities, and whether every unit of every
    entity differs from its surrogate."""

    def rows(keys: pa.Array, texts: list, found: list[list[Entity]]) -> dict[str, pa.Array]:
        kept = [all(untouched(t, es, rewritten(t, es, by), by) for by in ("placeholder", "surrogate")) if es else True for t, es in zip(texts, found)]
        changed = [all(u.rpartition("@")[0] != d for e in es for u, d in zip(e.units, e.drawn)) for es in found]
        return {"__key": keys, "untouched": pa.array(kept, pa.bool_()), "changed": pa.array(changed, pa.bool_())}

    return _per_text(docs, names, secret, key, text, rows, "untouched boolean, changed boolean")


def check_distinct(found: DataFrame) -> DataFrame:
    """kind, apart and together for the rows of ``find_entities``: whether different entities of a kind have different surrogates, and equal ones
    the same. Units are compared, so spelling, case and separators do not count. Pre-aggregated: distinct entities are shuffled, not texts."""
    pairs = found.select("kind", "units", "drawn").distinct()
    apart = pairs.groupBy("kind", "drawn", F.regexp_replace("units", "[^\x1f]*@", "").alias("within")).agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg((F.max("n") == 1).alias("apart"))
    together = pairs.groupBy("kind", "units").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg((F.max("n") == 1).alias("together"))
    return apart.join(together, "kind")
