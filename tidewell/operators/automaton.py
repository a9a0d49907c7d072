"""Names in texts with an Aho-Corasick automaton: one pass over a text finds all names, however many there are."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from ..functions.text import text_or_blank

_compiled: OrderedDict[str, ahocorasick.Automaton] = OrderedDict()


def compile_names(keys: list[str]) -> ahocorasick.Automaton:
    """Automaton whose values are the places of the names in ``keys``."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for place, key in enumerate(keys):
        machine.add_word(key, place)
    machine.make_automaton()
    return machine


def _of_worker(token: str, keys: list[str]) -> ahocorasick.Automaton:
    """Compiled once per Python worker; the one used before is given up, so that a long-lived worker holds two at most."""
    machine = _compiled.pop(token, None) or compile_names(keys)
    _compiled[token] = machine
    while len(_compiled) > 2:
        _compiled.popitem(last=False)
    return machine


def _letter(sign: str) -> bool:
    return "a" <= sign <= "z"


def best_place(machine: ahocorasick.Automaton, keys: list[str], text: str, boundary: bool) -> int | None:
    """Least place of a name inside a text.

    With ``boundary`` a name that begins (ends) with an ASCII letter or digit
    does not count behind (before) an ASCII letter.
    """
    if not boundary:
        return min(map(itemgetter(1), machine.iter(text)), default=None)
    best = None
    for end, place in machine.iter(text):
        if best is not None and place >= best:
            continue
        key = keys[place]
        start = end - len(key)  # the sign before
        if start >= 0 and _letter(text[start]) and (_letter(key[0]) or "0" <= key[0] <= "9"):
            continue
        if end + 1 < len(text) and _letter(text[end + 1]) and (_letter(key[-1]) or "0" <= key[-1] <= "9"):
            continue
        best = place
    return best


def longest_name_column(text: Column, names: Broadcast, boundary: bool) -> Column:
    """Name of the best place in each text, NULL where there is none; ``names`` holds (token, keys, names) in order of preference."""
    @arrow_udf("string")
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token, keys, shown = names.value
        machine = _of_worker(token, keys)
        for column in columns:
            places = [best_place(machine, keys, t.as_py() or "", boundary) for t in column]  # one text at a time
            yield pa.array([None if p is None else shown[p] for p in places], pa.string())

    return find(F.lower(text))


def with_longest_name(texts: DataFrame, text_col: str, dictionary: DataFrame, boundary: bool) -> DataFrame:
    """``texts`` with ``name``; ``dictionary`` (name, _n) must be of a checked size: it is collected, sorted and broadcast."""
    rows = dictionary.select("_n", "name").toArrow().to_pylist()
    rows.sort(key=lambda r: (-len(r["_n"]), r["_n"]))
    value = (uuid.uuid4().hex, [r["_n"] for r in rows], [r["name"] for r in rows])
    names = texts.sparkSession.sparkContext.broadcast(value)
    return texts.withColumn("name", longest_name_column(text_or_blank(text_col), names, boundary))
