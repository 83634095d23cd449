"""Fill-in-middle transformation: texts cut at units drawn by id, and put together around sentinels.

A unit is a run of ASCII letters or one other code point. One Aho-Corasick automaton, over classes of ASCII characters
(every other code point is one class more), finds the sentinels and the characters at which the class changes between
letters and the rest. Between two such events lies a gap of one class: of letters it is one unit, of others as many units
as code points. So the sparse events with their cumulative unit counts answer which code point a unit begins at, without
cutting the text into units. No pattern is longer than three characters, so the automaton's state after any character
follows from the last three, and all places of a batch take their three steps together in numpy.

Defined results: a null text is empty and an empty text plain; a text that holds a sentinel is plain; a null id draws as
the text `null` does; repeated rows get equal rows; only the two named columns are read, so other columns can have any
name; an empty table gives an empty result. Texts are taken whole, in batches of bounded bytes; no rows are shuffled.
"""

from __future__ import annotations

import hashlib
from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SENTINELS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LONGEST = 3
#: What an automaton's output says, as bits.
CHANGE, SENTINEL = 1, 2

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Automaton:
    """Aho-Corasick over character classes: `step[state, class]` with failure links folded in, `says[state]`."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], classes: int):
        goto: list[dict[int, int]] = [{}]
        says = [0]
        for pattern, bit in patterns:
            state = 0
            for c in pattern:
                if c not in goto[state]:
                    goto[state][c] = len(goto)
                    goto.append({})
                    says.append(0)
                state = goto[state][c]
            says[state] |= bit
        step = np.zeros((len(goto), classes), np.uint8)
        fail = [0] * len(goto)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for c in range(classes):
                if c in goto[state]:
                    to = goto[state][c]
                    fail[to] = int(step[fail[state], c]) if state else 0
                    says[to] |= says[fail[to]]
                    step[state, c] = to
                    queue.append(to)
                else:
                    step[state, c] = step[fail[state], c] if state else 0
        self.step, self.says = step, np.array(says, np.uint8)
        self.classes = classes

    def outputs(self, c: np.ndarray) -> np.ndarray:
        """What the state after each character says; no pattern may be longer than LONGEST."""
        flat, width = self.step.ravel(), self.classes
        state = np.zeros(len(c), np.uint8)
        for back in range(LONGEST - 1, -1, -1):  # before the first character stands the root
            state[back:] = flat[state[back:].astype(np.intp) * width + c[: len(c) - back]]
        return self.says[state]


def _classes() -> tuple[np.ndarray, list[int], list[int]]:
    """Class by code point (128 for all above), and the classes of letters and of others."""
    special = sorted(set("".join(SENTINELS)))
    of = np.zeros(129, np.uint8)
    for x in LETTERS:
        of[ord(x)] = 1
    for i, x in enumerate(special):
        of[ord(x)] = i + 2
    letters = [1] + [i + 2 for i, x in enumerate(special) if x in LETTERS]
    return of, letters, [0] + [i + 2 for i, x in enumerate(special) if x not in LETTERS]


CLASS, LETTER, OTHER = _classes()
IS_LETTER = np.isin(np.arange(CLASS.max() + 1), LETTER)


def automaton() -> Automaton:
    """Of the sentinels and of every pair of classes between which a unit's kind changes."""
    pairs = [(p, CHANGE) for x in LETTER for y in OTHER for p in ((x, y), (y, x))]
    return Automaton([(tuple(int(CLASS[ord(c)]) for c in s), SENTINEL) for s in SENTINELS] + pairs, int(CLASS.max()) + 1)


@dataclass
class Units:
    """Unit counts of texts that stand one after the other, each after a line break."""

    first: np.ndarray  # of each text, its place in the joined code points
    size: np.ndarray  # its code points
    count: np.ndarray  # its units
    marked: np.ndarray  # whether it holds a sentinel
    starts: np.ndarray  # of each gap, its place
    before: np.ndarray  # units of all gaps before it
    base: np.ndarray  # of each text, units of all texts before it

    def places(self, who: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The code point of text who[i] that its unit number unit[i] begins at; its size for one past the last."""
        total = self.base[who] + unit
        gap = np.searchsorted(self.before, total, "right") - 1
        at = self.starts[gap] + total - self.before[gap] - self.first[who]
        return np.where(unit == self.count[who], self.size[who], at)


def units(texts: list[str], scan: Automaton) -> Units:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size + 1) - size
    points = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le"), np.uint32) if texts else np.zeros(0, np.uint32)
    classes = CLASS[np.minimum(points, 128)]
    said = scan.outputs(classes)
    events = np.flatnonzero(said & CHANGE)
    # a gap begins at every event and at every text; where a text begins with a letter, its first gap is empty
    starts = np.concatenate([first, events])
    kind = np.concatenate([np.zeros(len(first), bool), IS_LETTER[classes[events]]])
    order = np.argsort(starts, kind="stable")
    starts, kind = starts[order], kind[order]
    ends = np.append(starts[1:], len(points))
    doc = np.searchsorted(first, starts, "right") - 1
    # the line break after a text belongs to no text: it ends the gap, or is a gap of its own
    ends = np.minimum(ends, (first + size)[doc])
    length = np.maximum(ends - starts, 0)
    number = np.where(kind, np.minimum(length, 1), length)
    total = np.cumsum(number)
    count = np.bincount(doc, number, len(texts)).astype(np.int64)
    marked = np.zeros(len(texts), bool)
    marked[np.searchsorted(first, np.flatnonzero(said & SENTINEL), "right") - 1] = True
    return Units(first, size, count, marked, starts, total - number, np.cumsum(count) - count)


def draws(seed: int, doc: int | None) -> list[int]:
    """Four numbers of 32 bits for a document, the same wherever and whenever they are drawn."""
    name = hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()
    return [int(name[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm_rate: int = 20
) -> DataFrame:
    """For each row its units, form (plain, psm or spm), lengths of prefix and middle, and output.

    `rate` of 100 texts are cut, `spm_rate` of 100 of those begin with the suffix.
    """

    def rows(ids: list, bodies: list[bytes]) -> dict[str, list]:
        texts = [b.decode() for b in bodies]
        scan = automaton()
        found = units(texts, scan)
        drawn = np.array([draws(seed, d) for d in ids], np.int64).reshape(-1, 4)
        cuts = np.sort(drawn[:, :2] % (found.count + 1)[:, None], 1)
        who = np.arange(len(texts))
        ends = [found.places(who, cuts[:, i]).tolist() for i in (0, 1)]
        plain = (found.size == 0) | found.marked | (drawn[:, 2] % 100 >= rate)
        form = np.where(plain, "plain", np.where(drawn[:, 3] % 100 < spm_rate, "spm", "psm")).tolist()
        output = []
        for text, kind, a, b in zip(texts, form, *ends, strict=True):
            if kind == "psm":
                text = PREFIX + text[:a] + SUFFIX + text[b:] + MIDDLE + text[a:b]
            elif kind == "spm":
                text = SUFFIX + text[b:] + PREFIX + text[:a] + MIDDLE + text[a:b]
            output.append(text)
        cut = [k != "plain" for k in form]
        return {
            "doc_id": ids,
            "n": found.count.tolist(),
            "form": form,
            "prefix_chars": [a if c else None for c, a in zip(cut, ends[0], strict=True)],
            "middle_chars": [b - a if c else None for c, a, b in zip(cut, *ends, strict=True)],
            "output": output,
        }

    return common.map_texts(common.id_and_text(df, id_col, text_col), rows, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text holds no sentinel, and none can arise where it meets one."""
    part = F.split(output, "|".join(SENTINELS))
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
with docs as (select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h from documents),
cut as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
  [('0x' || h[8 * i + 1:8 * i + 8])::bigint for i in range(4)] as hs from docs),
placed as (select *, len(units) as n, least(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) as a,
  greatest(hs[1] % (len(units) + 1), hs[2] % (len(units) + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or hs[3] % 100 >= 90
    then 'plain' when hs[4] % 100 < 20 then 'spm' else 'psm' end as form from cut),
parts as (select *, array_to_string(units[:a], '') as p, array_to_string(units[a + 1:b], '') as m,
  array_to_string(units[b + 1:], '') as s from placed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
  case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
