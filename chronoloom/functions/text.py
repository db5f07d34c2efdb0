"""Column functions on text: token matching, stems, keys, links, digests and estimates.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are dropped before labels are compared, and tokens that identify no engine.
LABEL_STOPWORDS = ("the", "a", "an", "of", "and")
ENGINE_NOISE = ("ggml", "bin", "model", "models", "v", "and", "the", "no", "with")
# Endings that a recogniser attaches to a name, in the order in which they are tried.
CLITICS = ("'s", "'ll", "'re", "'ve", "'d", "'m", "n't")
# File suffixes that are no part of a note's title.
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".svg", ".pdf")
LINK_SUFFIXES = (*ASSET_SUFFIXES, ".md")

# Fixed value: what a name token is made of.
TOKEN = "[A-Za-z][A-Za-z'’]*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text, dropped: tuple[str, ...] = LABEL_STOPWORDS) -> Column:
    """lower-case runs of letters and digits, without stop words."""
    return F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*dropped))


def engine_tokens(text) -> Column:
    """the distinct tokens of an engine's name."""
    return F.array_distinct(tokens(text, ENGINE_NOISE))


def padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def contains_run(haystack: Column, needle: Column) -> Column:
    """needle is a run of consecutive tokens of haystack; an empty needle is not."""
    return (F.size(needle) > 0) & F.contains(padded(haystack), padded(needle))


def label_matches(label, candidate, least: int = 3) -> Column:
    """one of the two is a token run of the other; candidates under `least` characters never match."""
    a, b = tokens(label), tokens(candidate)
    return (F.size(a) > 0) & (F.length(F.array_join(b, "")) >= least) & (contains_run(a, b) | contains_run(b, a))


def mentions(text, term) -> Column:
    """term occurs in text as whole tokens."""
    return contains_run(tokens(text), tokens(term))


def covers(start, end, at) -> Column:
    """a closed interval holds a point."""
    return _c(at).between(_c(start), _c(end))


def fold_surface(s) -> Column:
    """white space collapsed, lower case (Spark has no case folding: a sharp s stays)."""
    return F.lower(F.trim(F.regexp_replace(_c(s), r"\s+", " ")))


def stem(token) -> Column:
    """F8: lower case, straight apostrophes, none at the ends, and at most one clitic off if over one character is left."""
    low = F.replace(F.lower(_c(token)), F.lit("’"), F.lit("'"))
    bare = F.regexp_replace(F.regexp_replace(low, "^'+|'+$", ""), f"(?<=..)(?:{'|'.join(CLITICS)})$", "")  # no ending is the end of another, so their order does not matter
    return F.when(F.contains(low, F.lit("'")), bare).otherwise(low)


def fold_key(key) -> Column:
    """front-matter keys that differ in separators are one: runs of blanks and dashes become an underscore."""
    words = F.filter(F.split(F.translate(F.lower(F.trim(_c(key))), "-\t\n\r", "    "), " "), lambda w: w != "")
    edge = lambda at: F.when(F.substr(F.trim(_c(key)), F.lit(at), F.lit(1)) == "-", "_").otherwise("")
    return F.concat(edge(1), F.array_join(words, "_"), F.when(F.size(words) > 0, edge(-1)).otherwise(""))


def tolerance(a, b, short: int = 6) -> Column:
    """edits allowed between two spellings of one name."""
    return F.when(F.least(F.length(_c(a)), F.length(_c(b))) < short, 1).otherwise(2)


def near(a, b) -> Column:
    """within the tolerance.  Past the bound levenshtein gives -1, so both ends are tested."""
    one, two = F.levenshtein(_c(a), _c(b), 1), F.levenshtein(_c(a), _c(b), 2)
    return F.when(tolerance(a, b) == 1, one.between(0, 1)).otherwise(two.between(0, 2))


def name_tokens(text) -> Column:
    """F13."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0))


def stripped(text) -> Column:
    """Without the blanks at its ends: all of Unicode's space separators, which trim() leaves but for the space."""
    return F.regexp_replace(_c(text), r"\A\p{Zs}+|\p{Zs}+\z", "")


def link_pieces(text) -> Column:
    """What stands before each closing pair of brackets, since the one before."""
    pieces = F.split(_c(text), r"\]\]")
    return F.slice(pieces, 1, F.size(pieces) - 1)


def link_tail(piece: Column) -> Column:
    """The end of a piece that a link can stand in: it is on one line and holds no closing bracket."""
    return F.substring_index(F.substring_index(piece, "]", -1), "\n", -1)


def link_in(tail: Column) -> Column:
    """the link (target, anchor, display, is_embed) that a tail ends with, or null.

    It begins with the first opening pair; an exclamation mark before that makes it an embed.  An empty one is none.
    """
    at = F.instr(tail, "[[")
    body = F.when(at > 0, F.nullif(F.substr(tail, at + 2), F.lit("")))
    bar = F.instr(body, "|")
    left = F.when(bar > 0, F.substr(body, F.lit(1), bar - 1)).otherwise(body)
    mark = F.instr(left, "#")
    target = F.when(mark > 0, F.substr(left, F.lit(1), mark - 1)).otherwise(left)
    rest = lambda ok, whole, place: F.nullif(stripped(F.when(ok, F.substr(whole, place + 1))), F.lit(""))
    link = F.struct(stripped(target).alias("target"), rest(mark > 0, left, mark).alias("anchor"), rest(bar > 0, body, bar).alias("display"), F.coalesce(F.substr(tail, at - 1, F.lit(1)) == "!", F.lit(False)).alias("is_embed"))
    return F.when(body.isNotNull(), link)


def links(text) -> Column:
    """an array of the links of a text."""
    return F.array_compact(F.transform(F.transform(link_pieces(text), link_tail), link_in))


def link_name(target) -> Column:
    """the last path segment, without a known file suffix."""
    return F.regexp_replace(F.element_at(F.split(_c(target), "/"), -1), r"(?is)(?<=.)\.(" + "|".join(s[1:] for s in LINK_SUFFIXES) + r")\z", "")


def region_digest(body) -> Column:
    """SHA-256 of the lines without white space at their ends and without blank lines at the edges."""
    lines = F.transform(F.split(_c(body), "\n"), lambda x: F.rtrim(x, F.lit(" \t\f\r")))
    return F.sha2(F.trim(F.array_join(lines, "\n"), F.lit("\n")), 256)


def session_marks(title) -> Column:
    """what stands before, between and after the words session, as the number that it begins with, after blanks and a number sign, if any, and that ends as a word does; or null."""
    parts = F.split(F.lower(F.translate(_c(title), "\u0130", "i")), "session")  # one letter: lower() makes a letter and a mark of it, and a mark ends a word
    letter = r"[\p{L}\p{N}_]"

    def number(part: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        rest = F.ltrim(part, F.lit(" \t"))
        rest = F.when(F.startswith(rest, F.lit("#")), F.substr(rest, F.lit(2))).otherwise(rest)
        after = F.ltrim(rest, F.lit("0123456789"))
        word = (i > 0) & ~before.rlike(letter + "$") & ((i == 1) | (before != "")) & (after != rest) & ~after.rlike("^" + letter)
        return F.when(word, F.substr(rest, F.lit(1), F.length(rest) - F.length(after)))

    return F.transform(parts, number)


def session_reference(title) -> Column:
    """the first number that follows the word session."""
    return F.get(F.array_compact(session_marks(title)), F.lit(0)).try_cast("int")


def render_turn(turn_id, speaker, text) -> Column:
    """F20."""
    return F.concat(F.lit("["), _c(turn_id), F.lit("] ("), F.coalesce(_c(speaker), F.lit("unknown-speaker")), F.lit(") "), _c(text))


def estimated_tokens(text, per_token: float = 2.5) -> Column:
    """F21."""
    return F.ceil(F.length(_c(text)) / F.lit(per_token)).cast("bigint")


def json_object(text) -> Column:
    """the object in a fenced block, or the outermost braces; its text."""
    fenced = F.regexp_extract(_c(text), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)), F.lit(""))


def canonical_id(i) -> Column:
    """trailing digits as an integer."""
    return F.regexp_replace(_c(i), r"^(.*?)0*(\d+)$", "$1$2")


def overlap_ms(a0, a1, b0, b1) -> Column:
    """F24."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(_c(a1), _c(b1)) - F.greatest(_c(a0), _c(b0)))


def distinctive(label, least: int = 4) -> Column:
    """F25."""
    return F.filter(tokens(label), lambda t: F.length(t) >= least)


def literal_count(text, term) -> Column:
    """whole-word occurrences of a literal, whatever its case."""
    quoted = F.regexp_replace(F.lower(_c(term)), r"([^A-Za-z0-9_\s])", r"\\$1")
    return F.regexp_count(F.lower(_c(text)), F.concat(F.lit(r"\b"), quoted, F.lit(r"\b")))


def excerpt(text, most: int = 220) -> Column:
    """Cut with an ellipsis."""
    t = _c(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def share(n, d, places: int = 4) -> Column:
    """A10: null over zero."""
    return F.round(F.try_divide(_c(n).cast("double"), _c(d).cast("double")), places)


def finite(x) -> Column:
    """Numbers that JSON can hold."""
    return F.when(~(F.isnan(_c(x)) | (F.abs(_c(x)) == float("inf"))), _c(x))


def vary_digits(text, step) -> Column:
    """the n-th number of a line, if at most 24, moves by step * (n + 1) round the numbers 1 to 24; words and larger numbers stay."""
    parts = F.regexp_extract_all(_c(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.when(p.rlike(r"^0*\d{1,2}$"), F.try_to_number(F.right(p, F.lit(2)), F.lit("99"))).cast("int")
    nth = lambda i: F.size(F.filter(F.slice(parts, 1, i + 1), lambda q: q.rlike(r"^\d")))
    moved = lambda p, i: F.lit(1) + (number(p) + _c(step) * (nth(i) + 1)) % 24
    done = F.array_join(F.transform(parts, lambda p, i: F.when(number(p) <= 24, moved(p, i).cast("string")).otherwise(p)), "")
    return F.when(_c(step) == 0, _c(text)).otherwise(done)


def utc_stamp(at) -> Column:
    """a moment in UTC, to the second; the moment is passed in, so that a query that runs again says the same."""
    return F.date_format(F.to_utc_timestamp(_c(at), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
