"""Problem 5: personal information inside free text, found and replaced by typed placeholders.

A semi-Markov conditional random field labels whole spans.  Patterns propose candidate spans of
bounded length for each kind, names by their shape alone; features look at a whole span at once (its form,
the words before and behind it, case, digits, titles, and whether its words are common words, proper names
or unknown to the lexicon, which is read off the vocabulary of a public tokenizer); a dynamic program over
the candidates picks the best non-overlapping set, so boundaries and kinds are chosen together.  The
weights are trained by gradient ascent on the conditional likelihood over generated, labelled messages
(``TRAINING_TEXTS`` of them, a fixed seed; names are made of random syllables and the lexicon's proper
names), on the driver in a few seconds; tasks only receive the weights.

Texts are read through a folding of look-alike and full-width characters and without invisible ones;
spans are reported as written.

Defined results: null texts and senders hold nothing and stay null; an item that occurs twice in a
field is one row of the list and two placeholders; repeated ids count once; texts are read whole.
"""

from __future__ import annotations

import base64
import math
import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import LOOKALIKE, _invisible

KINDS = ("email", "phone", "id_number", "address", "person")
TRAINING_TEXTS, EPOCHS, SEED = 5000, 4, 7
#: A public tokenizer's vocabulary, one token a line by rank; its path is a parameter.
LEXICON = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of a lower rank are common words.
COMMON = 12_000
#: Titles, and the words of streets.
TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Madam|Herr|Frau|Sra|Srta|Sr|Mme|Mlle)"
STREET = r"(?:Street|St\.|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Drive|Court|Ct|Blvd|Boulevard|Terrace|Crescent|Square|Gardens|Grove|Hill|Row|Walk|Mews|Place|Parade|Highway|Way)"
BEFORE_NAME = r"(?:North|South|East|West|Great|Little|Old|New|Upper|Lower|Saint)"
_W = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_EDGE = r"(?<![\w@#£$€.,+]\d)"  # of a digit that has been read
_CAPITAL = "A-Z\u00c0-\u00d6\u00d8-\u00de\u0386-\u03ab\u0400-\u042f"
PATTERNS = [
    ("email", "plain", re.compile(r"(?<![\w.+-])[\w.+-]*\w@\w[\w-]*(?:\.\w[\w-]*)+")),
    ("email", "spelled", re.compile(r"(?<![\w.+-])[\w.+-]*\w\s*(?:\[at\]|\(at\)|\{at\}|<at>)\s*\w[\w-]*(?:\s*(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\s-?dot-?\s)\s*\w[\w-]*|\.\w[\w-]*)+", re.I)),
    ("email", "words", re.compile(r"(?<![\w.+-])[\w.+-]*\w -?at-? \w[\w-]*(?:\.\w[\w-]*)*(?: -?dot-? \w[\w-]*)+", re.I)),
    ("phone", "any", re.compile(r"(?<![\w#£$€/.,+-])(?:\+\s?\d{1,3}[\s./-]{0,2})?(?:\(\d{1,5}\)[\s./-]{0,2})?\d{1,12}(?:[\s./-]{1,2}\d{1,8}){0,6}(?![\w])")),
    ("id_number", "ssn", re.compile(r"\d(?<![\w#£$€/.+-]\d)\d{2}([ -])\d{2}\1\d{4}(?![\w/-])")),
    ("id_number", "ni", re.compile(r"(?<![\w#])[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d](?!\w)")),
    ("id_number", "letters_digits", re.compile(r"(?<![\w#])[A-Za-z]{1,3}\d{6,10}(?!\w)")),
    ("id_number", "groups", re.compile(r"\d(?<![\w#£$€/.+-]\d)\d{2,5}[-/]\d{3,6}(?:[-/]\d{1,6})?(?![\w/-])")),
    ("id_number", "digits", re.compile(r"\d(?<![\w#£$€/.+-]\d)\d{6,13}(?![\w/-])")),
    ("address", "number_street", re.compile(rf"\d{_EDGE}\d{{0,4}}[A-Ha-h]?,? (?:{BEFORE_NAME} )?{_W} (?:{_W} )?{STREET}(?![\w])", re.I)),
    ("address", "number_rue", re.compile(rf"\d{_EDGE}\d{{0,4}}[A-Ha-h]?,? (?:rue|avenue|boulevard|chemin|place|quai|impasse) (?:(?:de|du|des|la|le) )*{_W}", re.I)),
    ("address", "calle_number", re.compile(rf"(?<!\w)(?:Calle|Avenida|Av\.|Plaza|Paseo|Via|Viale|Piazza|Rua|Rue|Camino|Carrera) (?:(?:de|del|la|las|los|di|da) )*{_W} (?:n[oº.]* ?)?\d{{1,5}}[A-Ha-h]?(?!\w)", re.I)),
    ("address", "strasse_number", re.compile(r"(?<!\w)[^\W\d_]{2,}-?(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer|gatan|vägen|laan|straat) \d{1,5}[A-Ha-h]?(?!\w)", re.I)),
]


@lru_cache(maxsize=200_000)
def _plain(ch: str) -> str:
    if ch in LOOKALIKE:
        return LOOKALIKE[ch]
    if _invisible(ch) and ch not in "\t\n\r":
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    n = unicodedata.normalize("NFKC", ch)
    return n if len(n) == 1 else ch


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text as it reads, and where each of its characters stands (None: unchanged places)."""
    if text.isascii():
        return text, None
    out, at = [], []
    for i, ch in enumerate(text):
        p = ch if ch < "\x7f" else _plain(ch)
        if p:
            out.append(p)
            at.append(i)
    return "".join(out), at


@lru_cache(maxsize=2)
def lexicon(path: str) -> dict[str, str]:
    """The class of each whole word of the vocabulary: common, word, or proper (known only with a capital)."""
    out: dict[str, str] = {}
    with open(path, "rb") as f:
        for rank, line in enumerate(f):
            try:
                token = base64.b64decode(line.split()[0]).decode()
            except UnicodeDecodeError:
                continue
            w = token[1:]
            if token[:1] != " " or not w.isalpha():
                continue
            if w.islower():
                if out.get(w, "proper") == "proper":
                    out[w] = "common" if rank < COMMON else "word"
            elif w[0].isupper() and len(w) > 2:
                out.setdefault(w.lower(), "proper")
    return out


def _class(w: str, words: dict[str, str]) -> str:
    return words.get(w.lower(), "new")


_ID_WORDS = re.compile(r"(?i)\b(?:id|passport|nino|ni|ssn|social security|identity|licen[cs]e|insurance|national|tax)\b[^.!?;]{0,16}$")
_TITLED = re.compile(rf"(?<!\w){TITLE}\.? ((?:(?:{_W}|[^\W\d_]\.) ){{0,2}}{_W})(?![\w@])", re.I)
_TITLE_ENDS = re.compile(rf"(?<!\w){TITLE}\.? ?$", re.I)
_TITLE_ONLY = re.compile(rf"{TITLE}$", re.I)
_CUE = re.compile(rf"(?i)(?<!\w)(?:dear|hello|hi|hey|this is|signed(?: by)?|ask(?: for)?|it is for|my name is|i am|regards,?|wishes,?|yours|sincerely,?|attn:?|{TITLE}\.?) ({_W}|[^\W\d_]\.)")
#: Two capitalised words, with initials between; initials before a name; a family name before the given one.
_NO_NAME_BEFORE = rf"[{_CAPITAL}](?<![\w@.+'’-][{_CAPITAL}])"
_PAIR = re.compile(rf"{_NO_NAME_BEFORE}(?=([^\W\d_]+(?:['’-][^\W\d_]+)*(?: [^\W\d_]\.){{0,2}} [{_CAPITAL}][^\W\d_]*(?:['’-]?[^\W\d_]+)(?:['’-][^\W\d_]+)*)(?![\w@]))")
_INITIALS = re.compile(rf"{_NO_NAME_BEFORE}\. ?(?:[{_CAPITAL}]\. ?){{0,2}}([{_CAPITAL}]['’]?[^\W\d_]{{2,}}(?:['’-][^\W\d_]+)*)(?![\w@])")
_COMMA = re.compile(rf"{_NO_NAME_BEFORE}[{_CAPITAL}]{{2,}}(?:['’-][{_CAPITAL}]+)*, ([{_CAPITAL}][^\W\d_]+)(?![\w@])")
_BEHIND_CUE = re.compile(rf"(?:({_W})((?: [^\W\d_]\.){{0,2}}) ({_W})|([^\W\d_]\.(?: ?[^\W\d_]\.){{0,2}}) ?({_W})|({_W}), ({_W}))(?![\w@])")
_ONE_WORD = re.compile(_W)
_DIGIT = re.compile(r"\d")
#: Six digits with little between them: less is no phone and no identity number.
_SIX = re.compile(r"\d" + r"[\s./()-]{0,3}\d" * 5)
#: Words without which a pattern cannot match; a text is searched only for what it may hold.
_TITLE_WORDS = set("mr mrs ms miss mx dr prof professor sir madam herr frau sra srta sr mme mlle".split())
_CUE_WORDS = _TITLE_WORDS | set("dear hello hi hey this signed ask it my i regards wishes yours sincerely attn".split())
_STREET_WORDS = set(STREET[3:-1].lower().replace("\\.", "").split("|")) | set("rue avenue boulevard chemin place quai impasse".split())
_NUMBER_LAST = "straße strasse str. weg gasse platz allee damm ufer gatan vägen laan straat calle avenida av. plaza paseo via piazza rua rue camino carrera".split()
_SPELLED_AT = ("[at]", "(at)", "{at}", "<at>")
_LAST_WORDS, _NEXT, _DIGITS, _LETTERS = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]+|\S"), re.compile("[0-9]+"), re.compile("[A-Z]+")


def _names(text: str, seen: set[str], lex: dict[str, str]) -> list[tuple[int, int, str]]:
    """Candidate names by shape, and in any case behind words that a name is sure to follow."""
    out = []
    for m in _PAIR.finditer(text):
        s, e = m.start(), m.end(1)
        first, last = text[s:e].split(" ", 1)[0], text[s:e].rsplit(" ", 1)[1]
        if not first.isupper() or last.isupper():
            out.append((s, e, "given_initial_family" if "." in m.group(1) else "given_family"))
    for m in _INITIALS.finditer(text) if "." in text else ():
        out.append((*m.span(), "initials_family"))
    for m in _COMMA.finditer(text) if "," in text else ():
        out.append((*m.span(), "family_given"))
    for c in _CUE.finditer(text) if not seen.isdisjoint(_CUE_WORDS) else ():
        m = _BEHIND_CUE.match(text, c.start(1))
        if not m:
            continue
        g, mid, f, _, fam, last, first = m.groups()
        parts = [x for x in (g, f, fam, last, first) if x]
        if all(x[0].isupper() for x in parts) and not last or any(lex.get(x.lower()) == "common" for x in parts) or min(map(len, parts)) < 2:
            continue  # found by shape, or no name
        out.append((m.start(), m.end(), "family_given" if last else "initials_family" if fam else "given_initial_family" if mid else "given_family"))
    for m in _TITLED.finditer(text) if not seen.isdisjoint(_TITLE_WORDS) else ():
        out.append((*m.span(1), "after_title"))
        if text[m.start(1)].isalpha() and (w := _ONE_WORD.match(text, m.start(1))):
            out.append((m.start(1), w.end(), "after_title"))
    return out


def candidates(text: str, lex: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, form)`` of every span that may be an item; lengths are bounded by the forms."""
    out: set[tuple[int, int, str, str]] = set()
    low = text.lower()
    seen = set(_LAST_WORDS.findall(low))
    digits = bool(_DIGIT.search(text))
    six = digits and bool(_SIX.search(text))
    first, last = digits and not seen.isdisjoint(_STREET_WORDS), digits and any(w in low for w in _NUMBER_LAST)
    may = {"plain": "@" in text, "spelled": any(w in low for w in _SPELLED_AT), "words": "at" in seen and "dot" in seen, "number_street": first, "number_rue": first, "calle_number": last, "strasse_number": last}
    for kind, form, rx in PATTERNS:
        if may.get(form, six):
            for m in rx.finditer(text):
                if kind != "phone" or 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.add((*m.span(), kind, form))
    out.update((s, e, "person", f) for s, e, f in _names(text, seen, lex))
    return sorted(out)


def features(text: str, s: int, e: int, kind: str, form: str, field: str, lex: dict[str, str]) -> list[str]:
    """Features of a whole span; only a window of fixed length around it is read."""
    span = text[s:e]
    before = _LAST_WORDS.findall(text[max(0, s - 40) : s].lower())[-3:]
    gap = text[max(0, s - 2) : s]
    after = _NEXT.findall(text[e : e + 12].lower())[:1]
    words = _ONE_WORD.findall(span)
    b1 = before[-1] if before else "^"
    f = ["bias", f"form={form}", f"field={field}", f"b1={b1}", f"b2={' '.join(before[-2:])}", f"form={form}|b1={b1}", f"gap={'start' if s == 0 else gap[-1:]}"]
    f.append(f"digits={sum(c.isdigit() for c in span)}")
    if kind == "phone":
        shape = _DIGITS.sub(lambda m: str(len(m.group())), span)
        f += [f"plus={span[0] == '+'}", f"paren={'(' in span}", f"groups={len(_DIGITS.findall(span))}", f"shape={re.sub(r'[^0-9+()]', '-', shape)}"]
    if kind == "id_number":
        named = bool(_ID_WORDS.search(text, max(0, s - 30), s))
        f += [f"shape={_LETTERS.sub(lambda m: 'L' * len(m.group()), _DIGITS.sub('d', span.upper()))}", f"named={named}", f"named={named}|{form}"]
    if kind == "person":
        titled = form == "after_title" or bool(_TITLE_ENDS.search(text, max(0, s - 12), s))
        long = [w for w in words if len(w) > 1]
        kinds = [_class(w, lex) for w in long]
        case = "".join("U" if w.isupper() else "C" if w[0].isupper() else "l" for w in long)
        sign = "start" if s == 0 else gap.strip()[-1:] or gap[-1:]
        known = "".join(sorted({k[0] for k in kinds}))
        f += [f"titled={titled}", f"lex={' '.join(kinds[:2])}|{form}", f"known={known}|b1={b1}", f"known={known}|b1lex={lex.get(b1, 'new')}|{sign}", f"case={case}", f"last={kinds[-1] if kinds else ''}|titled={titled}", f"words={len(words)}|titled={titled}", f"any={'c' in known or 'w' in known}|case={case}"]
        if words and _TITLE_ONLY.match(words[0]):
            f.append("starts_with_title")
        if form in ("after_title", "given_family") and text[e : e + 1] == "," and titled and len(words) > 1:
            f.append("long_after_title")
    if kind == "address":
        f += [f"caps={sum(w[0].isupper() for w in words) * 3 // max(1, len(words))}", f"words={len(words)}", f"known={''.join(sorted({_class(w, lex)[0] for w in words}))}"]
    f.append(f"after={after[0] if after else '$'}")
    return [f"{kind}:{x}" for x in f]


def _lattice(text: str, field: str, words: dict[str, str]) -> list[tuple[int, int, str, str, list[str]]]:
    return [(s, e, k, form, features(text, s, e, k, form, field, words)) for s, e, k, form in candidates(text, words)]


def decode(text: str, field: str, weights: dict[str, float], words: dict[str, str]) -> list[tuple[int, int, str]]:
    """The best set of spans: dynamic programming over segment ends."""
    cand = _lattice(text, field, words)
    if not cand:
        return []
    cand.sort(key=lambda c: c[1])
    ends = [c[1] for c in cand]
    best: list[tuple[float, int]] = [(0.0, -1)]  # after the first k candidates: score, last chosen
    back: list[int] = []
    for k, (s, _, _, _, f) in enumerate(cand):
        j = k
        while j and ends[j - 1] > s:
            j -= 1
        score = best[j][0] + sum(weights.get(x, 0.0) for x in f)
        back.append(j)
        best.append((score, k) if score > best[k][0] else (best[k][0], -1))
    out, k = [], len(cand)
    while k:
        if best[k][1] == k - 1:
            s, e, kind, _, _ = cand[k - 1]
            out.append((s, e, kind))
            k = back[k - 1]
        else:
            k -= 1
    return out[::-1]


def _step(cand: list, gold: set[tuple[int, int, str]], weights: dict[str, float], squares: dict[str, float], rate: float) -> None:
    """One ascent step on log p(gold | text): observed minus expected features over the lattice."""
    cand = sorted(cand, key=lambda c: c[1])
    n = len(cand)
    w = [sum(weights[x] for x in c[4]) for c in cand]
    prev = [max((j + 1 for j in range(k) if cand[j][1] <= cand[k][0]), default=0) for k in range(n)]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    alpha = [0.0] * (n + 1)
    for k in range(n):
        alpha[k + 1] = add(alpha[k], alpha[prev[k]] + w[k])
    beta = [-1e9] * (n + 1)
    beta[n] = 0.0
    post = [0.0] * n
    for k in range(n, 0, -1):
        post[k - 1] = math.exp(min(0.0, alpha[prev[k - 1]] + w[k - 1] + beta[k] - alpha[n]))
        beta[k - 1] = add(beta[k - 1], beta[k])
        beta[prev[k - 1]] = add(beta[prev[k - 1]], w[k - 1] + beta[k])
    grad: dict[str, float] = defaultdict(float)
    for c, p in zip(cand, post):
        d = ((c[0], c[1], c[2]) in gold and c[3] == min(x[3] for x in cand if x[:3] == c[:3])) - p
        for x in c[4]:
            grad[x] += d
    for x, g in grad.items():
        g -= 0.002 * weights[x]
        squares[x] += g * g
        weights[x] += rate * g / math.sqrt(squares[x] + 1e-6)


def training_texts(n: int = TRAINING_TEXTS, seed: int = SEED, path: str = LEXICON) -> list[tuple[str, str, set[tuple[int, int, str]]]]:
    """Generated messages with their items: ``(text, field, {(start, end, kind)})``."""
    r = random.Random(seed)
    lex = lexicon(path)
    proper = sorted(w for w, k in lex.items() if k == "proper" and len(w) > 2)
    common = sorted(w for w, k in lex.items() if k != "proper" and 2 < len(w) < 9)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    syl = lambda k: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(k))
    onset = "b c d f g h j k l m n p r s t v w y z br ch cl dr fr gr kh kr mb mp nd ng ny pl pr qu sh sk sl st th tr ts wh zh".split()
    sound = lambda k: "".join(r.choice(onset) + r.choice("a e i o u aa ai ei ee ia ie ou oo".split()) for _ in range(k)) + r.choice(["", "", "n", "r", "l", "s", "m", "k", "t", "sh", "nd", "rt", "ng", "ck"])
    unknown = lambda: (sound(r.choice([1, 2, 2, 3])) if r.random() < 0.7 else r.choice("aeiou") + sound(r.choice([1, 2]))).title()
    word = lambda: r.choice(common)
    noun = lambda: word() if r.random() < 0.8 else word() + word() if r.random() < 0.6 else sound(2)
    verb = adj = word
    given = lambda: unknown() if r.random() < 0.5 else r.choice(proper).title() if r.random() < 0.8 else word().title()
    family = lambda: (unknown() if r.random() < 0.75 else r.choice(proper).title() if r.random() < 0.7 else word().title()) + (f"-{unknown()}" if r.random() < 0.04 else "")

    def person() -> tuple[str, str, str]:
        g, f = given(), family()
        x = r.random()
        if x < 0.22:
            return r.choice(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Mr ", "Ms ", "Prof. ", "Dr "]), f, ""
        if x < 0.3:
            return "", f"{g} {r.choice('ABDEFHJKLMNPRSTW')}. {f}", ""
        if x < 0.38:
            return "", f"{r.choice('ABDEFHJKLMNPRSTW')}. {f}", ""
        if x < 0.48:
            return "", f"{f.upper()}, {g}", ""
        if x < 0.56:
            return "", f"{g} {f}".upper(), ""
        if x < 0.6:
            return r.choice(["Mr. ", "Dr. ", "Mrs "]), f"{g} {f}", ""
        return "", f"{g} {f}", ""

    def email() -> str:
        local = r.choice([f"{syl(2)}.{syl(2)}", f"{syl(2)}{d(2)}", f"{syl(2)}_{syl(1)}", f"{syl(1)}-{syl(3)}", f"{syl(2)}+{syl(2)}"])
        parts = [syl(3), *r.choice([["example", "com"], ["test"], ["invalid"], ["example"], ["example", "net"]])]
        x = r.random()
        if x < 0.15:
            return f"{local} [at] " + " [dot] ".join(parts)
        if x < 0.25:
            return f"{local} (at) " + ".".join(parts)
        s = f"{local}@" + ".".join(parts)
        return s.upper() if r.random() < 0.1 else s

    def phone() -> str:
        return r.choice([f"+1 {d(3)} 555 {d(4)}", f"+{r.choice('123456789')}{d(10)}", f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"07{d(3)} {d(6)}", f"020 {d(4)} {d(4)}", f"+44 7{d(3)} {d(3)} {d(3)}", f"00{d(2)}-{d(4)}-{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"+9{d(2)} {d(3)} {d(3)} {d(2)}", f"0{d(9)}", f"+49 {d(3)} {d(7)}"])

    def identity() -> tuple[str, str]:
        up = lambda k: "".join(r.choice("ABCDEFGHJKLMNPRSTXYZ") for _ in range(k))
        return r.choice([("SSN ", f"{d(3)}-{d(2)}-{d(4)}"), ("social security number ", f"{d(3)} {d(2)} {d(4)}"), ("NI number ", f"QQ {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}"), ("NINO ", f"{up(2)}{d(6)}{r.choice('ABCD')}"), ("passport no. ", f"{up(2)}{d(7)}"), ("Passport: ", f"{up(1)}{d(8)}"), ("national ID ", f"{d(4)}-{d(4)}-{d(2)}"), ("identity card ", f"{d(6)}/{d(4)}"), ("driver licence ", f"{up(3)}{d(7)}"), ("ID no. ", d(9)), ("tax ID ", d(11))])

    def address() -> tuple[str, str]:
        w = family()
        no = f"{r.randint(1, 250)}{r.choice(['', '', '', 'a', 'b', 'c'])}"
        s = r.choice(["Street", "St.", "Road", "Rd", "Avenue", "Ave", "Lane", "Close", "Drive", "Court", "Blvd", "Way", "Hill"])
        pre = r.choice(["", "", "", "West ", "Great ", "Old ", "Upper ", "North ", "Little "])
        x = r.random()
        if x < 0.12:
            return f"{no} rue {w}", ""
        if x < 0.22:
            return f"{r.choice(['Calle', 'Via', 'Rua', 'Avenida'])} {w} {no}", ""
        if x < 0.36:
            return f"{w}{r.choice(['straße', 'str.', 'weg', 'gasse', 'platz', 'allee'])} {no}", ""
        out = f"{no} {pre}{w} {s}"
        return (out.lower() if r.random() < 0.15 else out), r.choice(["", "", f", Flat {d(2)}", f" Apt {d(1)}", f", Unit {d(2)}"])

    def plain() -> list[tuple[str, str]]:
        place, brand = (unknown() if r.random() < 0.8 else r.choice(proper).title() for _ in range(2))
        if r.random() < 0.25:
            place = f"{place} {r.choice([unknown, word])().title()}"
        if r.random() < 0.25:
            brand = f"{brand} {r.choice([unknown, word, word])().title()}"
        day = r.choice("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
        code = r.choice([f"#{d(6)}", f"A{d(6)}", f"ZK{d(6)}", f"{d(6)}Q", d(6), f"A{d(5)}"])
        amount = r.choice([f"£{d(2)}.{d(2)}", f"${d(3)}", f"{d(3)}.{d(2)} USD", f"EUR {d(3)}.{d(2)}"])
        return [(r.choice([
            f"{brand} toll office: unpaid {adj()} {noun()} of {amount}, {verb()} it today", f"Your {adj()} {noun()} is held at {place} depot, pay {amount}", f"new at {brand}: {verb()} a {adj()} {noun()} for {amount}",
            f"Earn {amount} a day to {verb()} {adj()} {noun()}s for {brand}, {verb()} by Monday", f"Dear client, {brand} {verb()}ed your {noun()} account {code}", f"Hello, the {adj()} {noun()} desk of {brand} has case {code}",
            f"{place} Monday deal: {adj()} {noun()} and {noun()} for {amount}", f"Last {d(2)} {adj()} {noun()}s at {place}, {verb()} one", f"meet me Friday at {place} with the {adj()} {noun()}", f"Club {brand}: {verb()} {d(1)} {noun()}s often, ref {code} from {place} is yours",
            f"tell the florist that {place} sold {d(2)} {noun()}s in {brand}", f"will {verb()} {noun()} with sister around {d(1)}:{d(2)} if {place} stays {adj()}", f"win {adj()} {noun()} with code {code}. {d(2)} {noun()}s at {place}", f"Wednesday works for the vet but {verb()} the {noun()} at {place} first",
            f"order {code} from {brand} Bank for {place}", f"Upgrade your {adj()} {noun()} at {place}: {noun()} plan {amount} a month, {verb()} {noun()} {code}", f"keep {noun()} {code}", f"Dear {adj()} client, {brand} {verb()}ed it", f"Dear client {brand} {verb()}ed your {noun()}", f"Final notice {place}: {amount} before Sunday", f"Hi there, {verb()} {d(2)} {adj()} {noun()} {r.choice(['way', 'drive', 'lane', 'place'])}", f"Hello again, Good Morning from {brand} Energy", f"It is for the {noun()} at {place}", f"signed by the {noun()} team",
            f"{day} {place} {noun()} and {noun()}", f"{brand} {word().title()} {word()} {word()}", f"{word().title()} {word().title()} at {brand} on {day}", f"{word().title()} {noun()} {place}: {verb()} {adj()} {noun()}", f"{verb()} the {noun()} near {place} {word()}", f"bus to {place} is {adj()} {day}", f"call {brand} about the {noun()}", f"ask {word()} for {noun()}", f"meet at {place} with the {noun()}", f"thanks for the {noun()} from {brand} {day}", f"with {noun()} and {noun()} from {place}",
            f"this is {adj()} {noun()}", f"dear {noun()} {noun()}", f"hello {noun()} {noun()}", f"hi {adj()} {noun()}", f"ask for {adj()} {noun()}",
            f"see https://{syl(3)}.example.com/{syl(3)}{d(2)} or www.{syl(3)}-box{d(2)}.test/{syl(2)}", f"did the sister {verb()} our {noun()} or the {adj()} one from {place}", f"{verb()} the {noun()} bill {amount}, date 20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"number {d(6)} and code {d(4)} {d(4)}"
        ]), "")]

    def items() -> list[tuple[str, str]]:
        x = r.random()
        if x < 0.3:
            t, p, _ = person()
            cue, tail = r.choice([("signed by ", ""), ("this is ", ""), ("regards, ", ""), ("ask for ", ""), ("it is for ", ""), ("my name is ", ""), ("Dear ", ","), ("Hello ", ","), ("Hi ", ","), ("I am ", ""), ("contact ", ""), ("meet ", f" {word()} {word()}"), ("call ", f" {word()}"), ("ring ", f" {word()}"), ("with ", f" {word()} {word()}"), ("wishes, ", ""), ("Yours ", ""), ("attn: ", ""), ("tell ", f" {word()} {word()}"), (f"{word()} ", f" {word()} {word()}"), (f"{word()} by ", ""), ("", f" {word()} the {word()}")])
            return [(cue + t, ""), (p, "person"), (tail, "")]
        if x < 0.47:
            b, a = r.choice([("contact ", " for it"), ("mail ", ""), ("write to ", ""), ("my address is ", ""), ("(", ")"), ("email: ", "")])
            return [(b, ""), (email(), "email"), (a, "")]
        if x < 0.64:
            return [(r.choice(["ring me on ", "call ", "text back ", "tel ", "Ph: ", "my new number is ", "phone "]), ""), (phone(), "phone")]
        if x < 0.82:
            words, value = identity()
            return [(r.choice(["my ", "send the ", "quote ", "it needs ", ""]) + words, ""), (value, "id_number")]
        a, rest = address()
        b, tail = r.choice([("drop it at ", ""), ("deliver to ", ""), ("come to ", ""), ("we live at ", " now"), ("I live at ", " now"), ("leave it with the guard, ", "")])
        return [(b, ""), (a, "address"), (rest + tail, "")]

    out = []
    for _ in range(n):
        if r.random() < 0.12:
            kind = r.choice(["email", "phone", "none"])
            parts = [(r.choice(["", "From: ", "tel:"]), ""), (phone(), "phone")] if kind == "phone" else [(email(), "email")] if kind == "email" else [(r.choice([d(5), f"VK-{syl(3).upper()}", f"INFO{syl(2).upper()}", f"Notice {syl(3).upper()}"]), "")]
            field = "sender"
        else:
            chunks = [plain() for _ in range(r.randint(1, 2))]
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                it = items()
                chunks.insert(0 if it[0][0].startswith(("Dear", "Hello", "Hi ")) else len(chunks), it)
            sep = r.choice([" ", ", ", ". ", " - ", "; ", "! ", "? ", " ... "])
            parts = [p for i, c in enumerate(chunks) for p in ([(" " if i and chunks[i - 1][-1][0] == "," else sep, "")] if i else []) + c]
            field = "text"
        low = r.random()
        text, gold = "", set()
        for p, kind in parts:
            p = p.lower() if low < 0.06 else p.upper() if low > 0.96 and kind != "address" else p
            if kind:
                gold.add((len(text), len(text) + len(p), kind))
            text += p
        out.append((text, field, gold))
    return out


@lru_cache
def train(n: int = TRAINING_TEXTS, epochs: int = EPOCHS, seed: int = SEED, path: str = LEXICON) -> dict[str, float]:
    """The weights of the random field."""
    data = [(_lattice(t, f, lexicon(path)), g) for t, f, g in training_texts(n, seed, path)]
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(float)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for cand, gold in data:
            if cand:
                _step(cand, gold, weights, squares, 0.3)
    return {k: round(v, 4) for k, v in weights.items() if abs(v) > 1e-3}


def find(text: str, field: str, weights: dict[str, float], path: str = LEXICON) -> list[tuple[int, int, str]]:
    """Spans of a text as written."""
    plain, at = fold(text)
    spans = decode(plain, field, weights, lexicon(path))
    return [(s if at is None else at[s], e if at is None else at[e - 1] + 1, k) for s, e, k in spans]


def scan(rows: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("text", "sender"), redact: bool = True, path: str = LEXICON) -> DataFrame:
    """``(id, field_name, redacted, items: array<struct<kind, found>>)``, one row per filled field;
    without ``redact`` the redacted texts are null.  Nothing is shuffled but the removal of repeated ids."""
    weights = train(path=path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            red, items = [], []
            for text, field in zip(b["value"], b["field_name"]):
                spans = find(text, field, weights, path)
                items.append([{"kind": k, "found": text[s:e]} for s, e, k in spans])
                if redact:
                    out, last = [], 0
                    for s, e, k in spans:
                        out += [text[last:s], f"[{k.upper()}]"]
                        last = e
                    red.append("".join(out) + text[last:])
            yield pd.DataFrame({"id": b["id"], "field_name": b["field_name"], "redacted": red if redact else None, "items": items})

    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]))
    once = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *fields).dropDuplicates(["id"])
    long = once.select("id", cells.alias("x")).select("id", "x.*").where("value is not null and value <> ''")
    kind = dict(rows.dtypes)[id_col]
    return long.mapInPandas(run, f"id {kind}, field_name string, redacted string, items array<struct<kind:string,found:string>>")


def listed(scanned: DataFrame) -> DataFrame:
    """``(id, field_name, kind, found)``, each item of a field once."""
    return scanned.select("id", "field_name", F.explode(F.array_distinct("items")).alias("x")).select("id", "field_name", "x.kind", "x.found")
