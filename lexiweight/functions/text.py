"""Column expressions that turn text into words and keys.

Everything here is a built-in Spark SQL expression, so Catalyst sees through it and no row ever
leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The results depend on exactly these characters and patterns.
WHITESPACE = r"[ \t\n\x0B\f\r]+"
TRAILING_WHITESPACE = r"[ \t\n\x0B\f\r]+\z"
PUNCTUATION = r"""[,.({}*=?!)'";:&]"""
NOT_A_TO_Z_FIRST = r"^[^a-z]+.*"
# A dot of the pattern above stops before these; words hold no other line ends.
LINE_SEPARATORS = r"[\u0085\u2028\u2029]"
# The folder name that Spark gives to null, and the mark of names that need one.
NULL_FOLDER, FOLDER_MARK = "__HIVE_DEFAULT_PARTITION__", "@"
CONTROL_ENDS = r"^[\x00-\x20]+|[\x00-\x20]+$"

PROFILES = ("raw", "raw_java", "clean")


def split_whitespace(text: Column) -> Column:
    """Array of the pieces between runs of white space; pieces at the ends may be empty."""
    return F.split(text, WHITESPACE)


def strip_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def blank_nonalpha_start(word: Column) -> Column:
    """Blanks a word that starts with anything but a-z, up to a line separator within it."""
    rest = F.when(word.rlike(LINE_SEPARATORS), F.regexp_replace(word, NOT_A_TO_Z_FIRST, "")).otherwise("")
    return F.when(starts_a_to_z(word), word).otherwise(rest)


def trim_token(word: Column) -> Column:
    """Strip every character up to U+0020 from both ends (Spark's ``trim`` strips blanks only)."""
    return F.regexp_replace(word, CONTROL_ENDS, "")


def starts_a_to_z(word: Column) -> Column:
    """True for words from ``a`` on and before ``{``, the character after ``z``."""
    return (word >= F.lit("a")) & (word < F.lit("{"))


def words(text: Column, profile: str = "raw") -> Column:
    """Array of the words of ``text``; null for null text.

    ``raw``       white-space separated words as they stand
    ``raw_java``  the same, but keeps the empty word that leading white space (or an empty text)
                  yields, and trims control characters from every word
    ``clean``     lower case, punctuation removed, only words that start with a-z, and what follows
                  a line separator (U+0085, U+2028, U+2029) within other words
    """
    if profile == "raw":
        return F.array_remove(split_whitespace(text), "")
    if profile == "raw_java":
        body = F.regexp_replace(text, TRAILING_WHITESPACE, "")
        pieces = (
            F.when(text == "", F.array(F.lit("")))
            .when(body == "", F.array().cast("array<string>"))
            .otherwise(split_whitespace(body))
        )
        return F.transform(pieces, trim_token)
    if profile == "clean":
        # Lower-casing and cleaning the text before the split costs one pass each per text
        # instead of one per word. Numbers need no test of their own: they do not start with a-z.
        pieces = split_whitespace(strip_punctuation(F.lower(text)))
        return F.array_remove(F.transform(pieces, blank_nonalpha_start), "")
    raise ValueError(f"unknown profile {profile!r}, expected one of {PROFILES}")


def document_id(path: Column) -> Column:
    """Last segment of a slash-separated path."""
    return F.element_at(F.split(path, "/"), -1)


def folder_of_corpus(corpus: Column) -> Column:
    """Name of the folder of a corpus: its own, marked where it is empty or could be mistaken."""
    special = (corpus == "") | (corpus == NULL_FOLDER) | corpus.startswith(FOLDER_MARK)
    return F.when(special, F.concat(F.lit(FOLDER_MARK), corpus)).otherwise(corpus)


def corpus_of_folder(folder: Column) -> Column:
    """Undo ``folder_of_corpus``."""
    marked = folder.startswith(FOLDER_MARK)
    return F.when(marked, F.substr(folder, F.lit(len(FOLDER_MARK) + 1))).otherwise(folder)


def make_key(first: Column, second: Column) -> Column:
    """Text key ``first@second``."""
    return F.concat_ws("@", first, second)


def split_key_last(key: Column) -> tuple[Column, Column]:
    """Undo ``word@document``: cut at the last ``@`` because words may contain more of them."""
    last = F.substring_index(key, "@", -1)
    return F.left(key, F.length(key) - F.length(last) - F.lit(1)), last


def split_key_first(key: Column) -> tuple[Column, Column]:
    """Undo ``document@word``: cut at the first ``@``."""
    first = F.substring_index(key, "@", 1)
    return first, F.substr(key, F.length(first) + F.lit(2))


def pack_ratio(numerator: Column, denominator: Column) -> Column:
    """Text ``numerator/denominator``."""
    return F.concat_ws("/", numerator.cast("string"), denominator.cast("string"))


def unpack_ratio(ratio: Column) -> tuple[Column, Column]:
    """The two whole numbers of a packed ratio; null where the text is not one."""
    parts = F.when(F.size(F.split(ratio, "/")) == 2, F.split(ratio, "/"))
    return F.get(parts, F.lit(0)).try_cast("bigint"), F.get(parts, F.lit(1)).try_cast("bigint")
