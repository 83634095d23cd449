"""Text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .batches import bounded_udf

#: Soft hyphen, zero-width space, non-joiner and joiner, byte order mark.
INVISIBLE = "[" + "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF))) + "]"
#: Quotation marks that stand around a quote.
QUOTES = "\"'„“”‚‘’«»"


def clean(text: Column) -> Column:
    """Invisible characters dropped, any white space turned into one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), r"(?U)\s+", " "))


def normalized(text: Column) -> Column:
    return F.lower(clean(text))


def worth_evaluating(text: Column) -> Column:
    """Three characters at least and three letters in a row."""
    return (F.length(text) >= 3) & text.rlike(r"\p{L}{3,}")


def sha(*parts: Column) -> Column:
    """sha256: and the hex digest of the parts joined by U+001F."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", *parts), 256))


def fingerprint(text: Column) -> Column:
    """The first 8 bytes of SHA-256, big-endian, as a signed long."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("long")


def url_hash(text: Column) -> Column:
    """The first 8 bytes of SHA-256, little-endian, as a signed long."""
    digest = F.sha2(text, 256)
    return F.conv(F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)]), 16, -10).cast("long")


def sentences(text: Column) -> Column:
    """Split after . ! ? or an ellipsis before an upper-case letter, a digit or an opening quote; 3 characters at least."""
    return F.filter(F.split(text, r'(?<=[.!?…])\s+(?=[\p{Lu}\d„"])'), lambda s: F.length(s) >= 3)


def keep_end(text: Column, n: int) -> Column:
    """The last n characters from a word boundary on, after an ellipsis where something was cut."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.lit("…"), F.regexp_replace(F.right(text, F.lit(n)), r"^\S* ", "")))


def keep_start(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(n)), r" \S*\z", ""), F.lit("…")))


def quote(text: Column) -> Column:
    """White space collapsed, outer quotation marks off, lower case."""
    return F.lower(F.trim(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(QUOTES)))


def whole_word(text: Column, label: Column) -> Column:
    """Whether the label stands in the text as whole words, both reduced to lower-case words."""
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.contains(F.concat(F.lit(" "), words(text), F.lit(" ")), F.concat(F.lit(" "), words(label), F.lit(" ")))


def without_marks(text: Column) -> Column:
    """Common Latin letters without their diacritics (a fixed table; see strip_marks for all of Unicode)."""
    return F.translate(text, MARKED, PLAIN)


#: Latin letters with marks and the letters they stand for, in the same order.
MARKED = "áàâäãåčçćďéèêëěíìîïľĺňñńóòôöõřŕšśťúùûüůýÿžźżÁÀÂÄÃÅČÇĆĎÉÈÊËĚÍÌÎÏĽĹŇÑŃÓÒÔÖÕŘŔŠŚŤÚÙÛÜŮÝŸŽŹŻ"
PLAIN = "aaaaaacccdeeeeeiiiillnnnooooorrsstuuuuuyyzzzAAAAAACCCDEEEEEIIIILLNNNOOOOORRSSTUUUUUYYZZZ"


@bounded_udf(StringType())
def strip_marks(text):
    """Any text decomposed, its non-spacing marks dropped, and composed again."""
    import unicodedata as u

    def one(s: str | None) -> str | None:
        if s is None or s.isascii():
            return s
        return u.normalize("NFC", "".join(c for c in u.normalize("NFD", s) if u.category(c) != "Mn"))

    return text.map(one)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(without_marks(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def language_tag(tag: Column) -> Column:
    """Lower case, trimmed, hyphens for underscores."""
    return F.lower(F.replace(F.trim(tag), F.lit("_"), F.lit("-")))


def language(tag: Column) -> Column:
    """The primary part of a language tag."""
    return F.element_at(F.split(F.lower(F.replace(tag, F.lit("_"), F.lit("-"))), "-"), 1)


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


def calling_code(number: Column) -> Column:
    """The calling code of an E.164 number: one digit for 1 and 7, two for the listed zones, else three."""
    digits = F.regexp_replace(number, r"\D", "")
    two = F.substring(digits, 1, 2)
    #: Calling codes of two digits.
    pairs = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
    one = F.substring(digits, 1, 1)
    return F.when(one.isin("1", "7"), one).when(two.isin(pairs), two).otherwise(F.substring(digits, 1, 3))


def rendered(template: Column, values: Column) -> Column:
    """The template with each {name} replaced by the value of the map."""
    return F.aggregate(
        F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"])
    )


def mock_probability(question: Column, text: Column, tokens: Column) -> Column:
    """A reproducible stand-in for a scoring model: high where a token occurs, with noise from a hash; 3 places."""
    digest = F.sha2(F.concat_ws("\x1f", question, text), 256)
    word = F.conv(F.concat(F.substring(digest, 3, 2), F.substring(digest, 1, 2)), 16, 10).cast("int")
    noise = F.round(word.cast("double") / 65535.0 * 0.08 - 0.04, 3)
    hit = F.exists(tokens, lambda t: F.contains(F.lower(text), F.lower(t)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(hit, 0.9).otherwise(0.06) + noise)), 3)


#: Abbreviations that something always follows (a name, a number, an example): their full stop ends no sentence.
LEADING = frozenset("approx dr mr mrs ms prof st vs e.g i.e cf no fig art al bzw z.b ca nr str tel tj např č ul".split())
#: Abbreviations that may stand last: their full stop ends a sentence before an upper-case letter or an opening mark.
TRAILING = frozenset("etc inc ltd co usw u.a atd apod".split())
CLOSING = "\"'”“»’)]"
OPENING = "\"'„“«‚‘([»"


def sentence_list(text: str | None, most: int = 1000) -> list[str]:
    """Sentences of a text: abbreviations, initials, dates and ellipses go on; closing quotes belong to what they close.

    A number of one or two digits goes on ("3. Payment", "3. May"); a longer one ends before an upper-case letter.

    A sentence over `most` characters is cut at the last "; ", ", ", dash or space in its second half, else hard.
    """
    out: list[str] = []
    for line in (text or "").split("\n"):
        start, at, n = 0, 0, len(line)
        while at < n:
            if line[at] not in ".!?…":
                at += 1
                continue
            end = at + 1
            while end < n and line[end] in ".!?…":
                end += 1
            while end < n and line[end] in CLOSING:
                end += 1
            word = line[start:at].rpartition(" ")[2].lower().lstrip("(\"'„“«")
            following = line[end:].lstrip()[:1]
            goes_on = following.islower()
            if line[at] == "." and end == at + 1:
                if word in LEADING or len(word) == 1 and word.isalpha() or word.isdigit() and (len(word) <= 2 or line[start:at].strip() == word):
                    goes_on = True
                elif word in TRAILING or word.isdigit():
                    goes_on = not (following.isupper() or following in OPENING)
            if end < n and (not line[end].isspace() or goes_on):
                at = end
                continue
            out += _cut(line[start:end].strip(), most)
            start = at = end
        out += _cut(line[start:].strip(), most)
    return out


def _cut(sentence: str, most: int) -> list[str]:
    out = []
    while len(sentence) > most:
        marks = (sentence.rfind(mark, most // 2, most) + len(mark.rstrip()) for mark in ("; ", ", ", " – ", " - ", " ") if sentence.rfind(mark, most // 2, most) >= 0)
        at = next(marks, most)
        out.append(sentence[:at].strip())
        sentence = sentence[at:].strip()
    return out + [sentence] * bool(sentence)


@bounded_udf(ArrayType(StringType()))
def split_sentences(text):
    return text.map(sentence_list)
