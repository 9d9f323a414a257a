"""Operator 8: quality rules by distribution divergence, in DataFrame expressions only.

Every document gets two histograms: characters by class and the share of each language's commonest words.  A language's
reference is counted from all documents that carry its label: its COMMON words of highest count (ties by word), their
shares, and its characters by class.  A document is kept if, for some language, its Jensen-Shannon distances to both
references stay under a limit.  Texts under a minimum length are not judged by divergence, as their histograms are mostly
noise.

Every label that has a word has a reference, however rare it is and however many labels there are.  Those with
1/LANGUAGES of all labelled words or more (so LANGUAGES at most) stand in the expressions as literals; all others stay a
table: their words meet the texts' words in a join, their characters are compared in blocks, and each row takes the smaller
distance.  Without such labels that step is not there.

Null or empty text: no words, fails the base rule (fewer than 50 words).  Null label: judged, but adds to no reference.
If no reference can be made (empty table, no label), the base rule alone decides.  Repeated rows are judged alike, each by
itself, and count each in the references; texts are read whole, whatever their length.  Other columns are not read.

Repeated windows are found by sorting 64-bit numbers, the window's hash with its place in the low bits (as many as the text's
length needs).  Windows whose hashes are neighbours are compared word by word; a text in which two of them differ is counted
again by sorting the windows themselves, so the count is exact at every length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

SPACES = "[ \\t\\n\\x0B\\f\\r]"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Character classes: the mark that stands for a class and the ASCII characters of it; all others are letters beyond ASCII.
CLASSES = {
    "v": "aeiouyAEIOUY",
    "c": "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ",
    "d": "0123456789",
    "s": ".,;:!?",
    "y": SYMBOLS,
    "m": "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in ".,;:!?" + SYMBOLS),
}
#: Classes of the divergence: the marks that make one.
GROUPS = ("v", "c", "d", "s", "ym")
#: Words of a language's reference, and the share of labelled words from which it is a literal.
COMMON, LANGUAGES = 16, 32
#: References of rare labels that a row is compared with at a time.
BLOCK = 256
#: Fewest non-space characters and words for a verdict by divergence, and the largest distance of each kind.
MIN_CHARS, MIN_WORDS = 200, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.45


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{SPACES}+"))


def marks_of(text: Column) -> Column:
    """The text with each ASCII character replaced by its class's mark, and no white space."""
    chars = "".join(CLASSES.values())
    return F.translate(text, chars + WHITE, "".join(mark * len(own) for mark, own in CLASSES.items()))


def count_of(text: Column, part: Column, width: int | Column = 1) -> Column:
    """How often a part of some width stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / width).cast("long")


def only(text: Column, words: list[str]) -> Column:
    """Of a text whose words each stand between two spaces, those that are listed.  One pattern, by first characters."""
    quoted = lambda w: "".join(c if c.isalnum() else f"\\{c}" if c.isascii() else c for c in w)
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(quoted(w[1:]))
    choices = "|".join(f"{quoted(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by.items()))
    return F.regexp_replace(text, f" (?!(?:{choices}) )[^ ]+ ", "") if words else F.lit("")


def class_counts(marks: Column) -> list[Column]:
    """Number of characters of each group, and of all others."""
    found = [reduce(add, (count_of(marks, F.lit(m)) for m in group)) for group in GROUPS]
    return [*found, F.length(marks).cast("long") - reduce(add, found)]


def _repeats(rows: DataFrame, size: int = 3, spare: int = 0) -> DataFrame:
    """Add ``n_repeat_words`` to rows with words ``w``: how many stand in windows of ``size`` words found twice or more.

    Each window becomes one number, its hash above its place; sorted, equal hashes are neighbours.  spare: bits of the hash
    that are left out besides, to let windows clash in tests.
    """
    hashed = ", ".join(f"get(w, i + {k})" for k in range(size))
    starts = f"sequence(0, size(w) - {size})"
    rows = rows.withColumn("high", F.expr(f"coalesce(shiftleft(-1L, length(bin(size(w))) + {spare}), 0L)"))
    rows = rows.withColumn("packed", F.expr(f"if(size(w) >= {size}, sort_array(transform({starts}, i -> coalesce((xxhash64({hashed}) & high) | i, 0L))), array())"))
    # Where a number's hash is its neighbour's too, both their places count, if their words are the same.
    rows = rows.withColumn("twice", F.expr("filter(sequence(0, greatest(size(packed) - 2, 0)), k -> (get(packed, k) ^ get(packed, k + 1)) & high = 0)"))
    place = lambda n: f"cast(get(packed, k + {n}) & ~high & {(1 << 31) - 1}L AS int)"
    differ = " OR ".join(f"get(w, {place(0)} + {d}) <> get(w, {place(1)} + {d})" for d in range(size))
    rows = rows.withColumn("clash", F.expr(f"exists(twice, k -> coalesce({differ}, false))"))
    # all windows themselves, sorted: only for texts in which hashes clash (a null array for the others)
    rows = rows.withColumn("windows", F.expr(f"if(clash, sort_array(transform({starts}, i -> struct(concat_ws(' ', {hashed}) AS s, cast(i AS long) AS i))), NULL)"))
    same = "filter(sequence(0, size(windows) - 2), k -> get(windows, k).s = get(windows, k + 1).s)"
    fast = [f"transform(twice, k -> coalesce(get(packed, k + {n}) & ~high, 0L))" for n in (0, 1)]
    slow = [f"transform({same}, k -> coalesce(get(windows, k + {n}).i, 0L))" for n in (0, 1)]
    rows = rows.withColumn("places", F.expr(f"sort_array(array_distinct(if(clash, concat({', '.join(slow)}), concat({', '.join(fast)}))))"))
    covered = f"aggregate(places, struct({-size}L AS last, 0L AS n), (s, i) -> struct(i AS last, s.n + least(i - s.last, {size}L) AS n), s -> s.n)"
    return rows.withColumn("n_repeat_words", F.expr(covered)).drop("high", "packed", "twice", "clash", "windows", "places")


@dataclass
class Reference:
    """A language's shares of characters by class, its commonest words and their shares of all its words."""

    lang: str
    chars: list[float]
    words: list[str]
    shares: list[float]


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES) -> tuple[list[Reference], DataFrame | None]:
    """The reference of each language, counted from all its documents: those with 1/languages of all labelled words or more as
    a list, all others as a table of a row each (None if there are none).

    Words are counted where they are read and then over all tasks; languages times COMMON rows at most come to the driver.
    """
    words = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.explode(words_of(F.lower(F.coalesce(F.col(text_col), F.lit(""))))).alias("word"))
    counts = cut(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    labels, total = sizes.agg(F.count("*"), F.sum("n")).first()
    of = {r["lang"]: r["n"] for r in sizes.filter(F.col("n") * languages >= total).collect()} if total else {}
    own = counts.filter(F.col("lang").isin(list(of)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top: dict[str, list] = {}
    for r in own.withColumn("place", place).filter(F.col("place") <= COMMON).orderBy("lang", "place").collect():
        top.setdefault(r["lang"], []).append((r["word"], r["n"]))
    marked = own.withColumn("marks", marks_of(F.col("word")))
    chars = marked.groupBy("lang").agg(*[F.sum(F.col("n") * x).alias(f"c{k}") for k, x in enumerate(class_counts(F.col("marks")))]).collect()
    out = []
    for r in sorted(chars, key=lambda r: r["lang"]):
        sums = [r[f"c{k}"] for k in range(len(GROUPS) + 1)]
        out.append(Reference(r["lang"], [x / sum(sums) for x in sums], [w for w, _ in top[r["lang"]]], [n / of[r["lang"]] for _, n in top[r["lang"]]]))
    return out, _rare(counts.filter(~F.col("lang").isin(list(of)))) if labels > len(of) else None


def _rare(counts: DataFrame) -> DataFrame:
    """A row for each label of word counts: its shares of characters by class, its commonest words with their shares, those
    shares' sum, and the label's rank by that sum."""
    whole = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("place", place).filter(F.col("place") <= COMMON).join(whole, "lang").withColumn("q", F.col("n") / F.col("all"))
    words = top.groupBy("lang").agg(F.collect_list(F.struct("word", "q")).alias("words"), F.least(F.sum("q"), F.lit(1.0)).alias("sum"))
    sums = [F.sum(F.col("n") * x).alias(f"c{k}") for k, x in enumerate(class_counts(F.col("marks")))]
    chars = counts.withColumn("marks", marks_of(F.col("word"))).groupBy("lang").agg(*sums)
    inked = reduce(add, (F.col(f"c{k}") for k in range(len(GROUPS) + 1)))
    shares = [F.col(f"c{k}") / inked for k in range(len(GROUPS))]
    chars = chars.select("lang", F.struct(F.array(*shares).alias("shares"), F.greatest(1 - reduce(add, shares), F.lit(0.0)).alias("rest")).alias("chars"))
    # two values a label, so that all ranks can be given in one window
    rank = words.select("lang", (F.row_number().over(Window.orderBy("sum", "lang")) - 1).alias("rank"))
    return cut(words.join(chars, "lang").join(rank, "lang").drop("lang"))


def _nearer(rows: DataFrame, rare: DataFrame, text_col: str) -> DataFrame:
    """The rows with the distances to rare labels' references, where they are smaller.

    The sum of a row and a label over the label's words is what it is without any of them, changed by each word that both
    have.  So only labels that share a word with the row are met in a join; of all others the nearest is the one of least
    rank, the first rank that the row has not met.
    """
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    rest = lambda p: F.expr(_term(f"greatest(1D - {p}, 0D)", "greatest(1D - sum, 0D)"))
    listed = rare.select("rank", "sum", F.inline("words"))
    found = rows.select("at", "n_words", F.explode(words_of(F.lower(F.coalesce(F.col("row")[text_col], F.lit(""))))).alias("word"))
    found = found.join(listed.select("word").distinct(), "word", "left_semi").groupBy("at", "word").agg((F.count("*") / F.first("n_words")).alias("p"))
    met = found.join(listed, "word").groupBy("at", "rank").agg(F.first("sum").alias("sum"), F.sum("p").alias("p"), F.sum(F.expr(_term("p", "q")) - F.col("q")).alias("j"))
    met = met.withColumn("j", F.col("j") + F.col("sum") + rest("p")).groupBy("at").agg(F.min("j").alias("met"), F.array_sort(F.collect_set("rank")).alias("ranks"))
    gap = F.expr("coalesce(get(filter(sequence(0, size(ranks)), i -> i = size(ranks) OR get(ranks, i) <> i), 0), 0)")
    alone = rare.select(F.col("rank").alias("gap"), (F.col("sum") + rest("0D")).alias("alone"))
    words = rows.select("at").join(met, "at", "left").withColumn("gap", gap).join(alone, "gap", "left")
    words = words.select("at", F.expr("sqrt(greatest(least(met, alone) / 2, 0D))").alias("words_near"))

    blocks = rare.groupBy((F.col("rank") / BLOCK).cast("int").alias("block")).agg(F.collect_list("chars").alias("refs")).select("refs")
    each = _distance("chars", "word_chars", "r.shares", "r.rest")
    chars = rows.select("at", "chars", "word_chars").crossJoin(blocks).select("at", F.expr(f"array_min(transform(refs, r -> {each}))").alias("near"))
    chars = chars.groupBy("at").agg(F.min("near").alias("chars_near"))
    rows = rows.join(words, "at").join(chars, "at")
    return rows.withColumn("char_distance", F.least("char_distance", "chars_near")).withColumn("word_distance", F.least("word_distance", "words_near")).drop("at", "words_near", "chars_near")


def _term(p: str, q: str) -> str:
    return f"(if({p} > 0, {p} * log2(2 * {p} / ({p} + {q})), 0D) + if({q} > 0, {q} * log2(2 * {q} / ({p} + {q})), 0D))"


def distance(counts: str, total: str, shares: list[float]) -> Column:
    """Jensen-Shannon distance of a column of counts to a reference's shares; what is left of 1 on either side is one class
    more."""
    literal = ", ".join(f"{q!r}D" for q in shares)
    return F.expr(_distance(counts, total, f"array({literal})", f"{max(0.0, 1.0 - sum(shares))!r}D"))


def _distance(counts: str, total: str, shares: str, rest: str) -> str:
    pairs = f"zip_with({counts}, {shares}, (c, q) -> named_struct('p', c / greatest({total}, 1), 'q', q))"
    step = f"named_struct('j', s.j + {_term('x.p', 'x.q')}, 'p', s.p + x.p)"
    return f"aggregate({pairs}, named_struct('j', 0D, 'p', 0D), (s, x) -> {step}, s -> sqrt(greatest((s.j + {_term('greatest(1D - s.p, 0D)', rest)}) / 2, 0D)))"


def judged(docs: DataFrame, found: tuple[list[Reference], DataFrame | None], text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Every row as ``row`` beside its base counts, smallest distances and verdict; without rare labels, in one pass and no shuffle."""
    refs, rare = found
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(lang_col).cast("string").alias("lang"), text.alias("t"), words_of(text).alias("w"))
    rows = _repeats(rows)
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("t"), f"{SPACES}+", "  "), F.lit(" "))
    words = sorted({w for r in refs for w in r.words})
    rows = rows.select("row", "lang", F.size("w").cast("long").alias("n_words"), marks_of(F.col("t")).alias("marks"), only(padded, words).alias("hits"), lines.alias("lines"), "n_repeat_words")
    common = [F.array(*[count_of(F.col("hits"), F.lit(f" {w} "), len(w) + 2) for w in r.words]).alias(f"common{k}") for k, r in enumerate(refs)]
    rows = rows.select(
        "row",
        "lang",
        "n_words",
        F.length("marks").cast("long").alias("word_chars"),
        count_of(F.col("marks"), F.lit("y")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*class_counts(F.col("marks"))[:-1]).alias("chars"),
        *common,
    )
    pairs = [(distance("chars", "word_chars", r.chars[:-1]), distance(f"common{k}", "n_words", r.shares)) for k, r in enumerate(refs)]
    none = F.lit(0.0) if rare is None else F.lit(None).cast("double")
    best = lambda cols: F.least(*cols) if len(cols) > 1 else cols[0] if cols else none
    rows = rows.withColumn("char_distance", best([c for c, _ in pairs])).withColumn("word_distance", best([w for _, w in pairs]))
    rows = rows if rare is None else _nearer(rows, rare, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    unsure = (F.col("n_words") < min_words) | (F.col("word_chars") < min_chars)
    near = unsure | ((F.col("char_distance") <= max_char) & (F.col("word_distance") <= max_word))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near).drop("chars", *[f"common{k}" for k in range(len(refs))])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES, **limits) -> DataFrame:
    """One row per input row: base counts, smallest distances and the verdict."""
    rows = judged(docs.select(id_col, text_col, lang_col), references(docs, text_col, lang_col, languages), text_col, lang_col, **limits)
    return rows.select(F.col("row")[id_col].alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def keep_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The rows that the rules keep, with all their columns; each row is judged by itself, whatever its id."""
    # The row's place is a part of the condition so that the optimiser leaves the filter behind the steps it reads from;
    # pushed below them it would repeat each step wherever the next one names it.
    rows = judged(docs, references(docs, text_col, lang_col), text_col, lang_col, **limits).withColumn("place", F.monotonically_increasing_id())
    return rows.filter(F.col("kept") & (F.col("place") >= 0)).select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of every text of ``documents``."""
    return judge(documents(spark, sf_dir)).drop("char_distance", "word_distance")
