"""Problem 10: text that looks the same in different characters, brought to one form.

Every character of a text is resolved to what it looks like: composed, narrow, without
invisible characters, look-alike punctuation replaced. A letter whose look exists in
several scripts has a set of scripts; the sets are intersected over each token. If one
script is left, the token is spelled in it; if several are (a whole-script confusable),
the script of the document's unambiguous letters decides; if none is (a token mixed
beyond repair), each letter goes to the first script of its look. The form depends on
nothing but the look, so texts look alike if and only if their forms are equal.

Which letters look alike is a table: the public list of confusable characters, as Unicode
publishes it, from a file or from the international components that Spark brings along,
and a few letters on top that it does not hold.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.session import staged, table

# Scripts in the order in which a look is spelled if nothing else decides.
SCRIPTS = "Latin Greek Cyrillic Armenian Georgian Hebrew Arabic Coptic Cherokee Lisu Tifinagh Runic Deseret Osage Vai".split()
_SCRIPT = [regex.compile(rf"\p{{scx={name}}}") for name in SCRIPTS]
# Letters that look the same, in the order Latin, Greek, Cyrillic; - = none.
LOOKS = """
a-а c-с d-ԁ e-е h-һ i-і j-ј l-ӏ oοо p-р q-ԛ s-ѕ w-ԝ x-х y-у
AΑА BΒВ C-С EΕЕ HΗН IΙІ J-Ј KΚК MΜМ NΝ- OΟО PΡР S-Ѕ TΤТ XΧХ YΥҮ ZΖ- G-Ԍ Q-Ԛ W-Ԝ
-ΓГ -ΠП -ΦФ
"""
# Punctuation that looks like the ASCII character behind it.
MARKS = {"ǃ": "!", "꞉": ":", "․": ".", "‐": "-", "‑": "-", "∶": ":"}
# Code points that show nothing (first, last).
INVISIBLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF),
]
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_LINE_END = re.compile(r"[^\S\n]*(?:\r\n?|[\n  \x85\x0b\x0c])[^\S\n]*")
_SPACES = re.compile(r"[^\S\n]+")
_COMPAT = [(0x132, 0x133), (0x13F, 0x140), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xB5, 0xB5), (0x2025, 0x2026), (0x2160, 0x217F), (0xFB00, 0xFB17)]


class _Plain(dict):
    """Code point -> the characters it looks like: narrow, without ligatures and Roman numerals; None if invisible."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if c in MARKS:
            plain = MARKS[c]
        elif any(a <= code <= b for a, b in INVISIBLE):
            plain = None
        elif kind in ("<wide>", "<narrow>") or kind == "<compat>" and any(a <= code <= b for a, b in _COMPAT):
            plain = unicodedata.normalize("NFKC", c)
        else:
            plain = c
        self[code] = plain
        return plain


_PLAIN = _Plain()


@lru_cache(maxsize=100_000)
def own_scripts(c: str) -> int:
    """The scripts that a letter belongs to, by its script extensions, as bits; 0 for other scripts and what is no letter."""
    return sum(1 << i for i, script in enumerate(_SCRIPT) if script.match(c)) if c.isalpha() else 0


Looks = dict[str, dict[int, str]]  # letter -> script bit -> the letter of that script with the same look


def _looks(alike: list[list[str]], preferred: str) -> Looks:
    """Classes of letters that look alike -> the table; a script's spelling is its first preferred letter, else its first one."""
    out: Looks = {}
    for letters in alike:
        spelled: dict[int, str] = {}
        for x in sorted(letters, key=lambda x: (x not in preferred, x)):
            for i in range(len(SCRIPTS)):
                if own_scripts(x) >> i & 1:
                    spelled.setdefault(1 << i, x)
        if len(letters) > 1:
            out |= dict.fromkeys(letters, spelled)
    return out


_FIXED = [list(look.replace("-", "")) for look in LOOKS.split()]
FIXED_LOOKS = _looks(_FIXED, "".join(LOOKS.split()))


def _letters() -> list[str]:
    """Letters of the scripts above that are no compositions, ligatures or styled forms."""
    single = re.compile(r"(<compat> [0-9A-F]+)?$")
    letters = (chr(c) for c in range(0x41, 0x1F000))
    return [c for c in letters if c.isalpha() and single.match(unicodedata.decomposition(c)) and own_scripts(c)]


def look_table(spark: SparkSession, path: str | None = None) -> Looks:
    """The letters that look alike: FIXED_LOOKS and the public list of confusables.

    path: a file of lines "source ; target ; ..." in code points, as Unicode publishes it (read by the driver, some
    thousand lines); without it the list within Spark's own international components. Letters
    are alike if they have one target and one case; what stands for several letters (rn for m) is left out.
    """
    letters = _letters()
    if path is None:
        builder = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")
        shown = builder().build().getSkeleton("\n".join(letters)).split("\n")
    else:
        target = {}
        for (line,) in spark.read.text(path).collect():
            parts = line.lstrip("\ufeff").partition("#")[0].split(";")
            if len(parts) >= 2:
                target[chr(int(parts[0], 16))] = "".join(chr(int(x, 16)) for x in parts[1].split())
        shown = [target.get(c, c) for c in letters]
    # a letter of a fixed class stays in it, and the class takes in what the list holds alike with its first letter
    home = {c: fixed for fixed in map(list, _FIXED) for c in fixed}
    classes: dict[tuple[str, bool, bool], list[str]] = {}
    key = lambda c, look: (look, c.isupper(), c.islower())
    for c, look in zip(letters, shown, strict=True):
        if c in home and home[c][0] == c:
            classes[key(c, look)] = home[c]
    for c, look in zip(letters, shown, strict=True):
        if c not in home:
            classes.setdefault(key(c, look), []).append(c)
    every = {id(x): x for x in (*home.values(), *classes.values())}
    return _looks(list(every.values()), "".join(LOOKS.split()))


class Speller:
    """Brings texts to their form by a table of looks; see the module's first lines."""

    def __init__(self, looks: Looks) -> None:
        self.looks = looks
        self._kept: dict[tuple[str, int], str] = {}

    def scripts(self, c: str) -> int:
        """The scripts in which a letter's look can be spelled."""
        return sum(self.looks[c]) if c in self.looks else own_scripts(c)

    def respelled(self, token: str, main: int) -> str:
        """A token (decomposed) in one script: the document's if the look allows it, else the first one it allows."""
        done = self._kept.get((token, main))
        if done is not None:
            return done
        common = -1
        for c in token:
            if s := self.scripts(c):
                common &= s
        one = main if common & main else common & -common
        out = []
        for c in token:
            spelled = self.looks.get(c)
            if spelled:
                bit = one if common > 0 else min(spelled)
                c = spelled.get(bit, spelled[min(spelled)])  # noqa: PLW2901
            out.append(c)
        if len(self._kept) > 200_000:
            self._kept.clear()
        done = self._kept[token, main] = "".join(out)
        return done

    def form(self, text: str) -> str:
        """The one form of all texts that look like this one."""
        return self.told(text)[0]

    def told(self, text: str) -> tuple[str, int, int]:
        """The form, how many tokens mix scripts, and how many of one script were spelled in another."""
        if text.isascii():  # spelled in Latin letters throughout, which is what the rule below gives
            return _spaced(text), 0, 0
        text = _spaced(unicodedata.normalize("NFD", text.translate(_PLAIN)))
        votes: dict[int, int] = {}
        written = 0
        for c, n in Counter(text).items():
            own = own_scripts(c)
            written |= own
            if (s := self.scripts(c)) and not s & (s - 1):
                votes[s] = votes.get(s, 0) + n
        main = max(votes, key=lambda b: (votes[b], -b)) if votes else 1
        mixed = whole = 0
        if written & ~main or any(c in self.looks and self.looks[c].get(main, c) != c for c in set(text)):

            def change(m: re.Match) -> str:
                nonlocal mixed, whole
                token = m.group()
                done = self.respelled(token, main)
                shared = -1
                for c in token:
                    shared &= own_scripts(c) or -1
                mixed += not shared
                whole += bool(shared) and done != token
                return done

            text = _TOKEN.sub(change, text)
        return unicodedata.normalize("NFC", text), mixed, whole


def _spaced(text: str) -> str:
    """White space of any width as one space, line ends as one kind, none at the ends of the text."""
    return _SPACES.sub(" ", _LINE_END.sub("\n", text)).strip()


_SPELLER = Speller(FIXED_LOOKS)


def look_form(text: str, speller: Speller = _SPELLER) -> str:
    """The one form of all texts that look like this one."""
    return speller.form(text)


def _forms(looks: Looks) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller = Speller(looks)
        for pdf in batches:
            told = [(None, None, None) if t is None else speller.told(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"]}).assign(**{n: pd.Series([t[i] for t in told], dtype=object) for i, n in enumerate(("form", "mixed", "whole"))})

    return forms


def _keys(looks: Looks) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller = Speller(looks)
        for pdf in batches:
            text = pdf["text"].tolist()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "look": [digest(speller.form(t)) for t in text], "exact": [digest(t) for t in text]})

    return keys


def to_one_form(documents: DataFrame, looks: Looks = FIXED_LOOKS) -> DataFrame:
    """(doc_id, form, mixed, whole): every text in its one form; a null text has a null form, an empty one an empty form.

    mixed counts the tokens written in letters of several scripts, whole those of one script that are spelled in another.
    """
    return documents.select("doc_id", "text").mapInPandas(_forms(looks), "doc_id bigint, form string, mixed int, whole int")


def _document_keys(documents: DataFrame, looks: Looks) -> DataFrame:
    """(doc_id, look, exact): 128-bit digests of the form and of the text itself."""
    keys = documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(_keys(looks), "doc_id bigint, look binary, exact binary")
    return staged(keys.distinct(), "looks")


def look_classes(documents: DataFrame, looks: Looks = FIXED_LOOKS) -> DataFrame:
    """(doc_id, class_id, strings): documents whose look is written in several ways; class_id is the least doc_id of the look.

    One row for each document, however often a look is copied. Null texts look like nothing; repeated rows count once.
    """
    keys = _document_keys(documents, looks)
    ways = keys.groupBy("look", "exact").agg(F.min("doc_id").alias("least"))
    ways = ways.groupBy("look").agg(F.min("least").alias("class_id"), F.count("*").alias("strings")).where("strings > 1")
    return keys.join(ways, "look").select("doc_id", "class_id", "strings")


def look_alikes(documents: DataFrame, looks: Looks = FIXED_LOOKS) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents whose texts differ as strings but look the same.

    Texts that look like no other text are dropped before pairs are made, and copies of one
    string are not paired with each other. Null texts look like nothing; repeated rows count
    once; texts are compared whole. A look that is copied much gives all its pairs: look_classes has
    the same in one row a document.
    """
    keys = _document_keys(documents, looks)
    strings = keys.select("look", "exact").distinct()
    varied = strings.groupBy("look").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("look")
    some = strings.join(varied, "look")
    # pairs of strings first, so that copies of one string never meet each other
    other = some.select("look", F.col("exact").alias("exact_b"))
    twins = some.withColumnRenamed("exact", "exact_a").join(other, "look").where(F.col("exact_a") < F.col("exact_b"))
    one = keys.select(F.col("exact").alias("exact_a"), F.col("doc_id").alias("a"))
    two = keys.select(F.col("exact").alias("exact_b"), F.col("doc_id").alias("b"))
    pairs = twins.select("exact_a", "exact_b").join(one, "exact_a").join(two, "exact_b").where(F.col("a") != F.col("b"))
    return pairs.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alikes(_texts(spark, sf_dir), look_table(spark))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of looks written in several ways, with their class."""
    return look_classes(_texts(spark, sf_dir), look_table(spark))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, form, mixed, whole) of every document."""
    return to_one_form(_texts(spark, sf_dir), look_table(spark)).distinct()


def p10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, without_form, unstable): what the forms must keep to; the last two are 0.

    unstable counts documents whose form has another form itself.
    """
    looks = look_table(spark)
    forms = staged(to_one_form(_texts(spark, sf_dir).where(F.col("text").isNotNull()), looks).select("doc_id", "form").distinct(), "forms")
    again = to_one_form(forms.withColumnRenamed("form", "text"), looks).select("doc_id", F.col("form").alias("again"))
    both = forms.join(again, "doc_id")
    return both.agg(
        F.count_distinct("doc_id").alias("documents"),
        F.count(F.when(F.col("form").isNull(), 1)).alias("without_form"),
        F.count(F.when(F.col("form") != F.col("again"), 1)).alias("unstable"),
    )
