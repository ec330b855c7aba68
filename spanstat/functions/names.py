"""Names of interval files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_bed(name: Column) -> Column:
    return F.regexp_replace(name, r"(\.clean)?\.bed(\.gz)?$", "")


def split_state(name: Column, states: Sequence[str]) -> tuple[Column, Column]:
    """cell and state of cell_state, by the longest state that ends the name."""
    alt = "|".join(sorted(states, key=lambda s: (-len(s), s)))
    pattern = rf"^(.*?)_({alt})$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def safe_name(name: Column) -> Column:
    """A file name's stem: no apostrophes, _ for slashes and spaces, word characters and - only."""
    s = F.translate(F.trim(name), "'/ ", "\0__")
    return F.regexp_replace(s, r"(?U)[^\w-]", "")


#: Accented letters and their plain ones.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: Endings that a trait's name can lose, in this order.
ENDINGS = (r"\s+combined$", r"\s+related\s+traits?$", r"\s+levels?$", r"\s+counts?$", r"\s+traits?$", r"\s+related$", r"\s+measurement$")


def normalised(name: Column) -> Column:
    """Lower case in ASCII, _ as a space, without apostrophes, single spaces."""
    s = F.regexp_replace(F.translate(name, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.translate(F.lower(s), "_'", " "), r"\s+", " "))


def candidates(name: Column) -> Column:
    """The forms of a name from the most to the least specific, each once."""
    base = normalised(name)
    cut = [F.trim(F.regexp_replace(base, e, "")) for e in ENDINGS]
    return F.array_distinct(F.filter(F.array(base, *cut), lambda x: x != ""))


def word_set(text: Column) -> Column:
    """The distinct words of a normalised text, without the s at their ends."""
    words = F.transform(F.split(text, " "), lambda w: F.regexp_replace(w, "s+$", ""))
    return F.array_distinct(F.filter(words, lambda w: w != ""))
