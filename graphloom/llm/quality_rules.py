"""Quality rules: clean each text line by line, then reject documents that lose too much text.

Everything is one projection over the scan: no shuffle, no Python.  Every array is bound once with ``let`` and
walked a fixed number of times, so a text of any length costs time in proportion (n log n where it repeats).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import SPACES, let, read, words

#: Phrases of boilerplate lines in English, German, French and Spanish, lower case, words parted by one space.
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "click here",
    "enable javascript",
    "lorem ipsum",
    "powered by",
    "privacy policy",
    "read more",
    "share this",
    "sign in",
    "subscribe to",
    "terms of service",
    "terms of use",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "hier klicken",
    "weiterlesen",
    "nutzungsbedingungen",
    "tous droits réservés",
    "accepter les cookies",
    "cliquez ici",
    "lire la suite",
    "conditions d utilisation",
    "todos los derechos reservados",
    "aceptar cookies",
    "haga clic aquí",
    "leer más",
    "términos de uso",
]
SYMBOLS = r"[#*$%&|<>]"
#: Words that are only a separator of a menu.
SEPARATOR = r"(?:^|[\x20\x09-\x0D])(?:\||>|»|›|•|·)(?:$|[\x20\x09-\x0D])"
#: Runs of marks that no sentence has.
MARKS = r"[!?#*$%&|<>]{2}[!?#*$%&|<>]*"
TERMINAL = r"[.!?:;,…。！？\"'”’»)\]][\x20\x09-\x0D]*$"


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def line_fails(line: Column, n: Column, boilerplate: list[str], boilerplate_words: int, share: int) -> Column:
    """Whether one line of ``n`` words fails a rule by itself; a line without words never does."""
    low = F.lower(line)
    navigation = (_count(line, SEPARATOR) >= 3) & (5 * _count(line, SEPARATOR) >= n)
    shouting = (n >= 3) & (2 * _count(line, MARKS) >= n)
    # Letters and digits in runs parted by one space: a phrase counts only between two of them.
    plain = F.concat(F.lit(" "), F.btrim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))

    def stock(text: Column) -> Column:
        words_of = F.lit(0)
        for p in boilerplate:
            words_of = words_of + F.when(F.contains(text, F.lit(f" {p} ")), p.count(" ") + 1).otherwise(0)
        return 100 * words_of >= share * n

    maybe = F.lit(False)
    for p in boilerplate:
        maybe = maybe | F.contains(low, F.lit(max(p.split(), key=len)))
    return (n > 0) & (shouting | navigation | ((n <= boilerplate_words) & maybe & let(plain, stock)))


def line_is_short(line: Column, n: Column, short: int) -> Column:
    """Whether a line is as short as a menu's, and no sentence."""
    return (n > 0) & (n < short) & ~F.rlike(line, F.lit(TERMINAL))


def _repeated_words(w: Column, span: int = 8) -> Column:
    """Words covered by windows of ``span`` (a power of two) words that occur at least twice."""

    def widen(h: Column, k: int) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - k), lambda x, i: F.xxhash64(x, F.get(h, i + k)))

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s: F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]))
        places = let(pairs, lambda s: F.array_sort(F.transform(same(s), lambda e: e["p"])))
        steps = lambda p: F.transform(p, lambda x, i: F.when(i == 0, span).otherwise(F.least(F.lit(span), x - F.get(p, i - 1))))
        return F.aggregate(let(places, steps), F.lit(0), lambda a, x: a + x)

    def build(h: Column, k: int) -> Column:
        if k == span:
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
        return let(widen(h, k), lambda wide: build(wide, 2 * k))

    return F.when(F.size(w) <= span, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: build(h, 1)))


def quality(
    docs: DataFrame,
    text_col: str = "text",
    min_words: int = 20,
    max_repeat_pct: int = 30,
    max_lost_pct: int = 50,
    boilerplate: list[str] = BOILERPLATE,
    boilerplate_words: int = 30,
    boilerplate_pct: int = 25,
    short_line: int = 3,
) -> DataFrame:
    """All columns of ``docs`` plus one struct column ``quality``.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, lost_words (words
    of removed lines), kept, clean_text (the lines that pass, joined by a newline).  A line fails by
    *punctuation* (marks such as !! or ### after half its words), by *navigation* (three or more lone separators,
    a fifth of its words; or fewer than ``short_line`` words and no end mark next to another such line, so that a
    heading over a paragraph stays) or by *boilerplate* (stock phrases, whole words, are ``boilerplate_pct`` of
    the words of a line of at most ``boilerplate_words``).  A document is rejected by the base rules, or when the
    removed lines hold more than ``max_lost_pct`` of its words.  Repeated windows are told by 64-bit hashes of
    their words.  A null text has no words and fails the base
    rules; so does an empty one.  Blank lines never fail.  Ids play no part, so repeated rows are judged
    alike; an empty table gives an empty result.  A column already called ``quality`` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def by_line(lines: Column) -> Column:
        marked = F.transform(
            lines,
            lambda x: let(
                F.size(words(x)),
                lambda n: F.struct(
                    x.alias("line"), n.alias("n"), line_fails(x, n, boilerplate, boilerplate_words, boilerplate_pct).alias("bad"), line_is_short(x, n, short_line).alias("short")
                ),
            ),
        )

        def judged(m: Column) -> Column:
            menu = lambda x, i: x["short"] & (F.coalesce(F.get(m, i - 1)["short"], F.lit(False)) | F.coalesce(F.get(m, i + 1)["short"], F.lit(False)))
            return F.transform(m, lambda x, i: F.struct(x["line"].alias("line"), x["n"].alias("n"), (x["bad"] | menu(x, i)).alias("bad")))

        return let(
            let(marked, judged),
            lambda m: F.struct(
                let(
                    F.transform(F.filter(m, lambda x: x["n"] > 0), lambda x: x["line"]), lambda g: F.size(g) - F.size(F.array_distinct(g))
                ).alias("dup"),
                F.aggregate(m, F.lit(0), lambda a, x: a + F.when(x["bad"], x["n"]).otherwise(0)).alias("lost"),
                F.array_join(F.transform(F.filter(m, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean"),
            ),
        )

    def verdict(w: Column, v: Column) -> Column:
        failed = (w["n"] < min_words) | (100 * w["rep"].cast("long") > max_repeat_pct * w["n"].cast("long"))
        return F.struct(
            w["n"].cast("long").alias("n_words"),
            w["chars"].cast("long").alias("word_chars"),
            _count(text, SYMBOLS).cast("long").alias("n_symbols"),
            v["dup"].cast("long").alias("n_dup_lines"),
            w["rep"].cast("long").alias("n_repeat_words"),
            failed.alias("base_failed"),
            v["lost"].cast("long").alias("lost_words"),
            (~failed & (100 * v["lost"].cast("long") <= max_lost_pct * w["n"].cast("long"))).alias("kept"),
            v["clean"].alias("clean_text"),
        )

    by_word = let(
        words(text),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated_words(w).alias("rep")),
    )
    return docs.withColumn("quality", let(by_word, lambda w: let(by_line(F.split(text, "\n")), lambda v: verdict(w, v))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"]
    out = quality(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality")
    return out.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


_SPACE = r"[\x20\x09-\x0D]"
_STOCK = " + ".join(f"case when contains(plain, ' {p} ') then {p.count(' ') + 1} else 0 end" for p in BOILERPLATE)
_MARKS, _SEPARATOR, _TERMINAL = MARKS, SEPARATOR, TERMINAL.replace("'", "''").replace(r"\"", '"')
ORACLE_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
x as (select doc_id, unnest(range(1, len(w) - 6)) as i, w from w where len(w) >= 9),
y as (select doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') as g from x),
z as (select doc_id, i, count(*) over (partition by doc_id, g) as n from y),
p as (select doc_id, i - lag(i) over (partition by doc_id order by i) as step from z where n >= 2),
r as (select doc_id, sum(least(8, coalesce(step, 8))) as rep from p group by doc_id),
l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from d),
m as (select doc_id, i, line, ' ' || trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' as plain, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
        len(regexp_extract_all(line, '{_MARKS}')) as marks,
        len(regexp_extract_all(line, '{_SEPARATOR}')) as seps from l),
s as (select *, n > 0 and n < 3 and not regexp_matches(line, '{_TERMINAL}') as short from m),
o as (select *, short and (coalesce(lag(short) over w, false) or coalesce(lead(short) over w, false)) as menu from s window w as (partition by doc_id order by i)),
b as (select doc_id, line, n, (n > 0 and ((n >= 3 and 2 * marks >= n) or menu
        or (seps >= 3 and 5 * seps >= n) or (n <= 30 and 100 * ({_STOCK}) >= 25 * n))) as bad from o),
c as (select doc_id, count(*) filter (where n > 0) - count(distinct line) filter (where n > 0) as dup,
        coalesce(sum(n) filter (where bad), 0) as lost from b group by doc_id),
f as (select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, dup, lost, coalesce(rep, 0) as rep
      from w join c using (doc_id) left join r using (doc_id)),
g as (select *, n_words < 20 or 100 * rep > 30 * n_words as failed from f)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       dup::bigint as n_dup_lines, rep::bigint as n_repeat_words, failed as base_failed,
       not failed and 100 * lost <= 50 * n_words as kept, lost::bigint as lost_words
from g
"""
