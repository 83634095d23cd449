"""Paragraphs of legal pages: the main text and then the rest, packed up to a length under the nearest heading.

Every page is folded in the Arrow batch that holds it, block by block, so nothing is shuffled and no page is gathered
from rows. Defined results: a page without blocks, or with headings only, has no paragraphs; a heading stands before
each of the paragraphs up to the next heading; blocks over the length are split at sentences, and a sentence over it at
the last separator in its second half; nothing else is cut, and what is too short or has no word is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import bounded

#: Characters of a paragraph with its heading, least characters, letters in a row that make a word.
MOST, LEAST, WORD = 1500, 3, 3
FIELDS = "id long, paragraph long, heading string, text string"


def pieces(text: str, room: int) -> Iterator[str]:
    """The text, or stretches of whole sentences of at most `room` characters."""
    if len(text) <= room:
        yield text
        return
    held = ""
    for sentence in T.sentence_list(text, room):
        if held and len(held) + 1 + len(sentence) > room:
            yield held
            held = ""
        held = f"{held} {sentence}" if held else sentence
    if held:
        yield held


def folded(blocks, most: int = MOST, least: int = LEAST, word: int = WORD) -> list[tuple[str | None, str]]:
    """(heading, text with heading) of the blocks (heading level, text) of one page."""
    out: list[tuple[str | None, str]] = []
    heading, parts, length = None, [], 0
    worth = re.compile(rf"[^\W\d_]{{{word}}}")

    def flush() -> None:
        nonlocal length
        whole = "\n".join(parts if heading is None else [heading, *parts])
        if parts and len(whole) >= least and worth.search(whole):
            out.append((heading, whole))
        parts.clear()
        length = 0

    for level, body in blocks:
        if level:
            flush()
            heading = body
            continue
        room = max(least, most - (0 if heading is None else len(heading) + 1))
        for piece in pieces(body, room):
            if parts and length + 1 + len(piece) > room:
                flush()
            length += len(piece) + (1 if parts else 0)
            parts.append(piece)
    flush()
    return out


def paragraphs(judged: DataFrame, most: int = MOST, least: int = LEAST, word: int = WORD) -> DataFrame:
    """(id, paragraph, heading, text) of pages with regions (`elements.judged`), paragraphs numbered from 0."""
    of = lambda region: F.filter("blocks", lambda b: b["region"] == region)
    blocks = F.transform(F.concat(of("main"), of("rest")), lambda b: F.struct(b["heading_level"].alias("level"), b["text"].alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, i, heading, text)
                for page, own in zip(batch["id"], batch["blocks"], strict=True)
                for i, (heading, text) in enumerate(folded([(b["level"], b["text"]) for b in own], most, least, word))
            ]
            yield pd.DataFrame(rows, columns=["id", "paragraph", "heading", "text"])

    bounded(judged.sparkSession)
    return judged.select("id", blocks.alias("blocks")).mapInPandas(run, FIELDS)
