"""Problem 10: sentence boundaries across languages and scripts, in SQL expressions only.

Dots that end no sentence (decimals, links, initials, abbreviations, ellipses before a small letter)
are masked by a private-use placeholder of the same length, so positions never move.  A mark is put
behind each terminator run with its closing quotes, brackets and smileys, by rules of the script; the
marked text is split and the lengths of its parts are summed.  Sentence texts are cut from the
original by position, which restores whatever was masked.

Defined results: null texts and ids give no sentence, blank texts none either; surrounding blanks
belong to no sentence; a text of any length is one row of expressions; repeated ids are repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK, BREAK = "", ""
SP = r" \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}"
#: Terminators, and words before a dot that (always, or unless a new sentence visibly starts) is no end.
LATIN_END = r".!?\x{2026}"
FULL_END = r"\x{3002}\x{FF01}\x{FF1F}\x{FF0E}\x{FF61}\x{61F}\x{6D4}\x{964}\x{965}"
ALWAYS = (
    "Dr Prof Mr Mrs Ms St Mt Messrs Gen Col Sgt Capt Lt Rev Hon Sen Gov Fig Figs Vol vol ref Ref approx vs viz cf pp Ph "
    "Sr Sra Srta Dra Ud Uds Vd Dña aprox pág págs av Av avda núm tel Tel art "
    "MM Mgr env éd "
    "Nr nr ca bzw vgl Hr Fr Fa Str str Abb Tel zzgl inkl exkl evtl ggf sog Hrsg "
    "г ул тыс млн млрд стр им просп пр д кв см рис гг "
    "डॉ रु श्री प्रो"
).split()
#: After these the dot is no end if a small letter, digit, sign of money or inner punctuation follows.
UNLESS_START = "etc usw руб коп Co Ltd Inc Corp Jr Bros Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec UU EE ej др пр Esq Dept est min max".split()
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Apr|Aug|Sept|Okt|Nov|Dez"
#: Words that carry on a sentence after a quotation that ends with a terminator, in scripts without case.
CARRY_ON = "と|って|という|然后|然後|便|就|并|並|说|說|道|而|才|और|कहकर|तथा|लेकिन|ثم|وقال|وأغلق|فقال"
NOT_WORD = r"(?<![\p{L}\p{M}\p{N}])"
CLOSE = rf"(?:[{SP}]?»|[\"'”’」』）)\]】》〉›\x{{FF02}}]|[“‘](?![\p{{L}}\p{{N}}]))"
SMILEY = rf"(?:[{SP}]?(?:[:;=]-?[)(DPp](?![\p{{L}}\p{{N}}])|\^\^|<3|[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}]\x{{FE0F}}?))"

#: (pattern, replacement, text it needs): each masks dots in place.  A pattern starts with the dot and looks behind
#: it for the word, so the alternatives are tried at dots only, not at every character.
MASKS = [
    # decimals, first dot of e.g.; initials; a single Arabic letter is a title
    (rf"\.(?:(?<=[\p{{L}}\p{{N}}]\.)(?=[\p{{Ll}}\p{{N}}])|(?<={NOT_WORD}[\p{{Lu}}\x{{620}}-\x{{64A}}]\.)(?=[{SP}]?[\p{{L}}]))", MASK, "."),
    # dots before capitals along a link of any length
    (rf"((?:(?:://|[wW]{{3}}[.{MASK}])|\G(?!^))(?:[^\s.]++|\.(?!\p{{Lu}}))*+)\.(?=\p{{Lu}})", f"$1{MASK}", ("://", "www", "WWW", "Www")),
    # first dot of abbreviations in two parts, and the last one of those that always go on
    (rf"\.(?<=(?<![\p{{L}}\p{{M}}\p{{N}}{MASK}])\p{{L}}\.)(?=[{SP}]?\p{{L}}{{1,2}}[.{MASK}]|-)", MASK, "."),
    (rf"\.(?<={NOT_WORD}(?:z{MASK}[{SP}]?B|d{MASK}[{SP}]?h|i{MASK}e|e{MASK}g|p{MASK}[{SP}]?ej|т{MASK}[{SP}]?е|c{MASK}-à-d|o{MASK}[{SP}]?Ä|v{MASK}[{SP}]?a)\.)", MASK, MASK),
    # abbreviations by what follows them, numbers and dates
    (
        rf"\.(?:(?=[{SP}]*[^\s{SP}])(?<={NOT_WORD}(?:{'|'.join(ALWAYS)})\.)"
        rf"|(?=[{SP}]*[\p{{Ll}}\p{{N}}$£€#(,;:/-])(?<={NOT_WORD}(?:{'|'.join(UNLESS_START)}|[ap]{MASK}m|т{MASK}[{SP}]?[дп]|u{MASK}[{SP}]?a)\.)"
        rf"|(?=[{SP}](?:Ltd|Inc|KG|Corp))(?<={NOT_WORD}Co\.)|(?=[{SP}]?UU)(?<={NOT_WORD}EE\.)"
        rf"|(?=[{SP}]?#?\p{{Lu}}{{0,3}}\p{{N}})(?<={NOT_WORD}(?:[Nn]os?|p)\.)|(?=[{SP}](?:{MONTHS})(?![\p{{L}}]))(?<=\p{{N}}\.))",
        MASK,
        ".",
    ),
    # an ellipsis before a small letter, or one inside a sentence of a script without case
    (rf"\.(?=\.+[{SP}]*\p{{Ll}})|\.(?<=\.\.)(?=[{SP}]*\p{{Ll}})", MASK, ".."),
    (rf"\x{{2026}}(?=\x{{2026}}*[{SP}]*\p{{Ll}})|\x{{2026}}(?<!\x{{2026}}\x{{2026}})(?=[\p{{Ll}}\p{{Lo}}])", MASK, "\u2026"),
]
_RUN = rf"[{LATIN_END}{FULL_END}]++"
_INNER = rf"(?![{SP}]*+[,;:，、；：،؛])(?![{SP}]++[—–-]++[{SP}]++\p{{Ll}})"
_AFTER_CLOSE = rf"(?![{SP}]*+(?:\p{{Ll}}|[—–]|(?:{CARRY_ON})))"
#: Behind these a mark is put: a run with closers; a run of full-width ends; a run of Latin ends
#: before a blank, a quote or bracket, a letter of another script, or a capital after a small letter.
ENDS = (
    rf"(?![\p{{L}} ])(?=[{LATIN_END}{FULL_END}])(?:"  # most characters are letters and blanks: one look each
    rf"((?:{_RUN}{CLOSE}++)++(?:{_RUN})?+{SMILEY}?+){_INNER}{_AFTER_CLOSE}(?![\p{{Ll}}\p{{N}}])"
    rf"|([{LATIN_END}{FULL_END}]++(?<=[{FULL_END}])(?!{CLOSE}){SMILEY}?+){_INNER}"
    rf"|((?<=[\p{{Ll}}\p{{Lo}}])[{LATIN_END}]++(?=\p{{Lu}})|[{LATIN_END}]++(?!{CLOSE}){SMILEY}?+(?=[\s{SP}]|$|\p{{Lo}}|[“„«「『（(\[【《¿¡\"])){_INNER})"
)
#: Blanks that belong to no sentence.
BLANKS = " \t\n\x0b\f\r\x85\u200b\ufeff\u2028\u2029\u00a0\u202f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
THAI = r"[\x{E01}-\x{E3A}\x{E40}-\x{E4E}]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda a plain expression is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _masked(pattern: str, put: str, needs: str | tuple[str, ...]) -> Callable[[Column], Column]:
    """One mask; a text without the characters it is about is not searched."""
    has = lambda t: reduce(lambda a, b: a | b, [t.contains(x) for x in ([needs] if isinstance(needs, str) else needs)])
    return lambda t: F.when(has(t), F.regexp_replace(t, F.lit(pattern), F.lit(put))).otherwise(t)


def marked(text: Column) -> Column:
    """The text with masked dots and a mark behind each sentence; unmarked, its length is unchanged."""
    out = F.translate(text, MASK + BREAK, "\ufffd\ufffd")
    for mask in MASKS:
        out = _let(out, _masked(*mask))
    ends = F.regexp_replace(out, ENDS, f"$1$2$3{BREAK}")
    thai = F.regexp_replace(ends, rf"[{SP}](?<={THAI}[{SP}])[{SP}]*+(?={THAI})", f"$0{BREAK}")
    return F.regexp_replace(thai, r"[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+", f"{BREAK}$0")


def _starts(sizes: Column, run: int = 256) -> Column:
    """Where each of the parts begins, from their lengths: sums inside runs of parts and over the runs, so
    the lists that grow are short (a list that grows by one element is copied each time)."""
    grown = lambda xs, at, size: F.aggregate(xs, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + size(n)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    zero = F.lit(0)
    runs = F.transform(F.sequence(zero, F.floor((F.size(sizes) - 1) / run).cast("int")), lambda c: F.slice(sizes, c * run + 1, run))
    total = lambda r: F.aggregate(r, zero, lambda a, n: a + n)
    at = lambda rs: grown(F.transform(rs, total), zero, lambda n: n)
    return _let(runs, lambda rs: F.flatten(F.zip_with(rs, at(rs), lambda r, begin: grown(r, begin, lambda n: n))))


def spans(text: Column) -> Column:
    """``array<struct<start, end>>`` of a text's sentences, in code points; ``end`` is exclusive."""
    measured = lambda parts: F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), F.length(F.rtrim(p, F.lit(BLANKS))).alias("to"), (F.length(p) - F.length(F.ltrim(p, F.lit(BLANKS)))).alias("lead")))
    placed = lambda ps: F.zip_with(ps, _starts(ps["n"]), lambda p, at: F.struct((at + p["lead"]).alias("start"), (at + p["to"]).alias("end"), p["to"].alias("to")))
    kept = lambda ps: F.transform(F.filter(placed(ps), lambda x: x["to"] > 0), lambda x: F.struct(x["start"], x["end"]))
    return _let(F.split(marked(text), BREAK), lambda parts: _let(measured(parts), kept))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``(id, number, start_char, end_char[, sentence])``, one row per sentence."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    out = rows.select("_id", *(["_t"] if with_text else []), F.posexplode(spans(F.col("_t"))).alias("number", "s"))
    cols = [F.col("_id").alias(id_col), (F.col("number") + 1).alias("number"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char")]
    text = [F.substring(F.col("_t"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("sentence")] if with_text else []
    return out.select(*cols, *text)
