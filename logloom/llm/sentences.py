"""Sentence units of texts in any language, script or mixture with code, with their places.

A text is first cut into blocks: fenced and indented code (a unit each), and runs of prose between blank lines and list items. Within prose,
marks that may end a unit are visited from left to right. Addresses, inline code and quotations or parentheses inside a longer sentence are
passed over whole. At each other mark a cascade of rule tables decides: every rule is a pattern for what stands before the place, one for what
stands after it, and a verdict, and the first rule that matches counts; the last table breaks.

The cascade begins and ends with tables for all languages. Between them stand those of the languages of the block: by its script, or by the
function words in it, several where it mixes languages; a block with fewer than three takes those of the whole text, too. Labels of texts aren't asked, as
they are often wrong. Whether an abbreviation that may end a sentence does so is told by what follows: a capitalised function word of the same
languages begins a sentence, a word in lower case or a name goes on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters that are white space in Unicode's sense.
_WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Marks that end a sentence only before white space (or at the end), and marks that need none.
SPACED, CLOSE = ".!?…．؟۔‼⁇⁈⁉።܀", "。！？｡।॥။៕"
CLOSERS = "\"'”’»›)]}」』）》】〉〕］｝*_"
_EMOJI = r"(?:[\p{Extended_Pictographic}--[\p{Ascii}©®™‼⁉]]|[\U0001F1E6-\U0001F1FF])[\ufe0f\u200d\U0001F3FB-\U0001F3FF\U0001F1E6-\U0001F1FF\p{Extended_Pictographic}--\p{Ascii}]*"
_AFTER = regex.compile(rf"[{regex.escape(CLOSERS)}]*(?:[ \t\xa0]*{_EMOJI})*", regex.V1)
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\u3000-\u303f\uff00-\uffef"
_THAI = r"ก-ฺเ-๎"


@dataclass(frozen=True)
class Rule:
    before: regex.Pattern
    after: regex.Pattern
    breaks: bool


def _rule(before: str, after: str, breaks: bool) -> Rule:
    # What stands before is matched backwards from the mark.
    return Rule(regex.compile(before, regex.V1 | regex.REVERSE), regex.compile(after, regex.V1), breaks)


#: Function words by language: they tell the languages of a text, and, capitalised, that a sentence begins.
FUNCTION_WORDS = {
    "en": "the a an and or but if of to in on at for with from by is are was were has have do does not no this that these those it he she they we you i my your our there here then so what why how when who which however every nobody another",
    "de": "der die das ein eine einen und oder aber nicht ist sind war im am mit von zu für auf bei nach wie was warum wo ich er sie es wir man dann den dem in sich an so unter noch auch",
    "fr": "le la les un une des du et ou mais ne pas est sont il elle on nous vous je que qui pour avec sur dans au ce cette pourquoi comment puis l j qu",
    "es": "el la los las un una y o pero no es son en de del con por para que qué cómo al se lo su este esta luego muy hay tiene ya",
    "it": "il lo la gli un una e o ma non è sono di del della con per che si questo come perché poi",
    "pt": "o a os as um uma e ou mas não é são de do da com por para que em se este como depois",
}
_WORDS_OF = {lang: words.split() for lang, words in FUNCTION_WORDS.items()}
_LANGUAGES_OF = {w: [lang for lang, words in _WORDS_OF.items() if w in words] for words in _WORDS_OF.values() for w in words}
_LETTERS = re.compile(r"[^\W\d_]+")
_SCRIPTS = {"hi": re.compile("[ऀ-ॿ]"), "ar": re.compile("[؀-ۿ]"), "ru": re.compile("[Ѐ-ӿ]")}
#: Words that go on with a sentence after a quotation or an ellipsis where letters' case tells nothing.
GOING_ON = frozenset("and or but while when because is was says said und oder aber weil et ou mais y o pero e ma mas".split())


def _abbreviations(*words: str) -> str:
    """Any of the words as a whole with its full stop, in any case; between the parts of one any white space may stand."""
    alternatives = "|".join(r"\s*".join(map(regex.escape, w.split())) for w in words)
    return rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{alternatives})\."


def _titles(*words: str) -> str:
    """Any of the words as a whole with its full stop, capitalised or in capitals."""
    return rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?i:{'|'.join(map(regex.escape, words))})\."


_SPACE, _LOWER, _NAME = r"\s", r"\s+\p{Ll}", r"\s+[\"'“«„(]?[\p{Lu}\p{Lo}]"
_NUMBER, _BEGINS = r"\s+[^\s\p{L}]{0,2}\p{N}", "begins"  # the latter stands for the capitalised function words
_ENDING = ("inc", "ltd", "co", "corp", "rd", "ave", "blvd", "st", "jr", "u.s", "u.k", "u.n", "e.u", "a.m", "p.m", "b.c", "a.d", "ph.d")

#: (before, after, whether a unit ends there); the first table begins the cascade, the last two end it, the others are those of languages.
TABLES: dict[str, list[tuple[str, str, bool]]] = {
    "first": [
        (rf"[{CLOSE}]+", "", True),
        ("", r"\Z", True),
        ("[!?]+", rf"[{_CJK}]", True),
        (rf"[{regex.escape(SPACED)}]+", r"\S", False),
        (r"(?:\.{2,}|…+)", r"\s+[\"'“«„(]?\p{Ll}", False),
        (r"\p{Lu}{2}(?:\.{2,}|…+)", rf"\s+(?:{'|'.join(sorted(w.upper() for w in GOING_ON))})\b", False),
        # A name that ends with such a mark: followed by its version, or inside a sentence that goes on.
        (r"\p{Lu}\p{L}*[!?]", r"\s+\p{N}+(?:\.\p{N}+)+", False),
        (r"(?:\p{Ll}[,;:]?|\.\s?\p{L}\.)[ \t\xa0]+\p{Lu}[\p{L}\p{N}]*!", r"[ \t\xa0]+\p{Ll}", False),
    ],
    "en": [
        (_abbreviations(*_ENDING), _BEGINS, True),
        (_abbreviations(*_ENDING), _SPACE, False),
        (_titles("mr", "mrs", "ms", "mt", "ft", "gen", "col", "capt", "lt", "sgt", "rev", "hon", "sen", "rep", "gov", "pres"), _NAME, False),
        (_abbreviations("jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "apt", "bldg", "rm", "ext"), _NUMBER, False),
        (_abbreviations("mr", "mrs", "ms", "dr", "prof", "dept", "est", "max", "min", "ver", "fig", "sec"), _LOWER, False),
        (_abbreviations("fig", "figs", "eq", "tab", "app"), r"\s+\p{Lu}(?!\p{L})", False),
    ],
    "de": [
        (_abbreviations("z. b", "d. h", "u. a", "u. u", "i. d. r", "s. o", "v. a", "z. t", "lt", "inkl", "exkl", "einschl", "zzgl", "abzgl", "ca", "bzw", "vgl", "evtl", "ggf", "sog", "bspw", "mind"), _SPACE, False),
        (_abbreviations("usw", "u. s. w", "o. ä", "str", "jh"), _BEGINS, True),
        (_abbreviations("usw", "u. s. w", "o. ä"), _LOWER, False),
        (_abbreviations("str", "jh"), _SPACE, False),
        (r"(?<!\p{L})[IVXLC]+\.", _LOWER, False),
        (_titles("hr", "hrn", "fr", "dipl", "ing"), _NAME, False),
        (r"(?i)(?<!\p{L})(?:im|am|zum|vom|beim|ab|bis|seit|der|die|das|den|dem|des|jede[rnms]?|ein(?:e[rnms]?)?)\s+\p{N}{1,3}\.", _BEGINS, True),
        (r"(?i)(?<!\p{L})(?:im|am|zum|vom|beim|ab|bis|seit|der|die|das|den|dem|des|jede[rnms]?|ein(?:e[rnms]?)?)\s+\p{N}{1,3}\.", r"\s+\p{L}", False),
        (r"(?<![\p{N}.,])\p{N}{1,2}\.", r"(?i)\s+(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Kapitel|Mal|Stock)\b", False),
    ],
    "fr": [
        (_abbreviations("p. ex", "c.-à-d", "c. -à-d", "env"), _SPACE, False),
        (_titles("m", "mm", "mme", "mlle", "mgr", "me", "pr", "st", "ste"), _NAME, False),
        (_abbreviations("chap", "n°", "art", "av", "apr"), r"\s+(?:\p{N}|J\.)", False),
        (_abbreviations("boul", "av"), _NAME, False),
    ],
    "es": [
        (_abbreviations("p. ej", "aprox"), _SPACE, False),
        (_abbreviations("ee"), r"\s+UU\b", False),
        (_abbreviations("ee. uu", "ud", "uds", "vd", "vds"), _BEGINS, True),
        (_abbreviations("ee. uu", "ud", "uds", "vd", "vds"), _SPACE, False),
        (_titles("sr", "sra", "srta", "dra", "d", "dña", "lic"), _NAME, False),
        (_abbreviations("avda", "pza"), _NAME, False),
    ],
    "it": [
        (_abbreviations("p. es", "per es"), _SPACE, False),
        (_abbreviations("sig", "sig.ra", "sigg", "dott", "dott.ssa", "avv", "ing"), _NAME, False),
        (_abbreviations("ecc"), _LOWER, False),
    ],
    "pt": [
        (_abbreviations("p. ex", "por ex", "aprox"), _SPACE, False),
        (_titles("sr", "sra", "srta", "dra", "exmo"), _NAME, False),
    ],
    "hi": [(r"(?<![\p{L}\p{M}])(?:डॉ|प्रो|श्री|सु|कु|रु|पं|मो)\.", _SPACE, False)],
    "ar": [(r"(?<![\p{L}\p{M}])(?:[\p{Arabic}]|أ\.د|ص\.ب|م\.م|إلخ)\.", r"\s+[\p{L}\p{N}]", False)],
    "ru": [(_abbreviations("т. е", "т. д", "т. п", "т. к", "др", "г", "гг", "руб", "стр", "рис", "им", "см"), r"\s+[\p{Ll}\p{N}]", False)],
    "last": [
        (_abbreviations("cf", "e.g", "eg", "i.e", "ie", "viz", "vs", "approx", "resp", "a.k.a"), _SPACE, False),
        (_titles("dr", "drs", "prof"), _NAME, False),
        (_abbreviations("no", "nos", "nr", "p", "pp", "sec", "secs", "fig", "figs", "eq", "ch", "vol", "ver", "v", "max", "min", "art", "ed", "para", "ref", "tab", "abb", "abs", "bd", "kap", "chap", "cap", "pag", "pagg", "pág", "págs", "núm", "n", "tel"), _NUMBER, False),
        (_abbreviations("no", "nos", "sec", "fig", "figs", "ch", "chap", "vol", "art", "tab", "bd", "kap", "cap"), r"\s+(?!I\b)[IVXLCDM]+(?!\p{L})", False),
        (_abbreviations("ca", "et al"), r"\s+[(\[]?\p{N}", False),
        (_abbreviations("etc", "et al"), _LOWER, False),
        (r"(?<![\p{L}\p{N}])(?:\p{Lu}\.){2,}", _BEGINS, True),
        # Initials, unless a sentence begins after a single letter.
        (r"(?<![\p{L}\p{N}.])[\p{Latin}\p{Cyrillic}]\.", _BEGINS, True),
        (r"(?<![\p{L}\p{N}])[\p{Latin}\p{Cyrillic}]\.", "", False),
        (r"(?<![\p{N}.,])\p{N}{1,2}\.", r"\s+\p{N}", False),
    ],
    "default": [("", "", True)],
}


def _first_rules() -> dict[str, list[Rule]]:
    """The first table's rules by the marks they may stand behind: single ones, and the doubled last character for runs of several."""
    rules = [_rule(*r) for r in TABLES["first"]]
    samples = {c: ["a Aa" + c] for c in SPACED + CLOSE} | {c * 2: [f"{before}{run}" for before in ("a Aa", "AA") for run in (c * 2, "?" + c, "!" + c, "." + c, "。" + c)] for c in SPACED + CLOSE}
    return {mark: [r for r in rules if any(r.before.match(x) for x in texts)] for mark, texts in samples.items()}


_FIRST = _first_rules()


#: What the rules of all tables after the first may stand behind.
_GATE = regex.compile("|".join(f"(?i:{b[4:]})" if b.startswith("(?i)") else b for t, rules in TABLES.items() if t not in ("first", "default") for b in dict.fromkeys(r[0] for r in rules)), regex.V1 | regex.REVERSE)


@lru_cache(maxsize=256)
def cascade(languages: frozenset[str]) -> list[Rule]:
    """The rules after the first table's for a text in these languages."""
    words = sorted({w for lang in languages if lang in _WORDS_OF for w in _WORDS_OF[lang]} or set(_WORDS_OF["en"]))
    begins = rf"\s+[\"“«„(]?(?:{'|'.join(f'{w.capitalize()}|{w.upper()}' for w in words)})(?![\p{{L}}.'’-])"
    return [_rule(b, begins if a == _BEGINS else a, v) for t in (*sorted(languages), "last", "default") for b, a, v in TABLES[t]]


def languages_of(text: str, begin: int, stop: int) -> tuple[frozenset[str], int]:
    """The languages, among those with tables, that text[begin:stop] is in, by its scripts and function words, none if nothing tells; and how
    many function words speak for the first."""
    found = {lang for lang, letters in _SCRIPTS.items() if letters.search(text, begin, stop)}
    score, alone = Counter(), Counter()
    for w, n in Counter(filter(_LANGUAGES_OF.__contains__, _LETTERS.findall(text[begin:stop].lower()))).items():
        of = _LANGUAGES_OF[w]
        for lang in of:
            score[lang] += n
        if len(of) == 1:
            alone[of[0]] += n
    most = max(score.values(), default=0)
    if most:
        found |= {lang for lang, n in score.items() if n == most or alone[lang] >= 2}
    return frozenset(found), most


_SPANS = regex.compile(
    r"(?P<code>(?<!`)(`+)(?!`)[^\n]*?(?<!`)\2(?!`))"
    r"|(?P<span>“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|《[^《》]*》|（[^（）]*）|\([^()]*\)"
    r"|(?<!\w)\"(?=\S)[^\"]*\"(?!\w)|(?<!\w)'(?=\S)(?:[^']|(?<=\w)'(?=\w))*'(?!\w)|(?<!\w)‘(?=\S)[^‘]*?’(?!\w))"
    rf"|(?P<mark>[{regex.escape(SPACED + CLOSE)}]+)"
    rf"|(?P<thai>(?<=[{_THAI}])[ \t\xa0\u2009\u3000]+(?=[{_THAI}]))",
    regex.V1,
)
_MARKS = frozenset(SPACED + CLOSE)
_MARK = re.compile(f"[{re.escape(SPACED + CLOSE)}]+")
# Where one of the above may begin: a plain class, so that the search for it is quick; blanks count only in texts with Thai letters.
_NEXT = re.compile(f"[{re.escape(SPACED + CLOSE)}`“„«「『《（(\"'‘]")
_NEXT_THAI = re.compile(f"[{re.escape(SPACED + CLOSE)}`“„«「『《（(\"'‘ \\t\xa0\u2009\u3000]")
_THAI_LETTER = re.compile(f"[{_THAI}]")
_ADDRESS = regex.compile(r"(?:https?|ftp)://[^\s\p{Han}\p{Hiragana}\p{Katakana}]+|(?<![\w.])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_FENCE = regex.compile(r" {0,3}(`{3,}|~{3,})([^`\n]*)\Z")
_ITEM = regex.compile(r" {0,3}(?:([-*+•])|(\d{1,9})[.)])(?:[ \t\xa0]+|\Z)")
_ENDED = regex.compile(rf"[{regex.escape(SPACED + CLOSE)}][{regex.escape(CLOSERS)}]*[\s]*\Z", regex.V1)
_PARENTHESES = "(（"
_WORD_THERE = regex.compile(r"[\s]*(\p{L}+)", regex.V1)
# Who speaks, after a quotation: a name or "I", and a verb of saying.
_SPEAKER = regex.compile(r"\s+(?:I|\p{Lu}\p{L}+(?:\s+\p{Lu}\p{L}+)?)\s+(?:said|says|asked|asks|replied|answered|cried|shouted|whispered|thought)\b")
_NAME_THERE = regex.compile(r"(?<!\p{L})\p{Lu}[\p{L}\p{N}]*!", regex.V1 | regex.REVERSE)
_NAME_INSIDE = regex.compile(r"\p{Ll}[ \t\xa0]+(\p{Lu}[\p{L}\p{N}]*!)[ \t\xa0]+\p{Ll}")
_LOWER_NEXT = regex.compile(r"[ \t\xa0]+\p{Ll}")
_BLANKS = re.compile(f"[{_WHITE}]*")
_LOWER_WORD = regex.compile(r"(?<!\p{L})\p{Ll}\p{L}{3}")


@lru_cache(maxsize=8)
def _languages_in(text: str, begin: int, stop: int) -> frozenset[str]:
    """The languages of a block and, if few of its words tell, of its whole text."""
    found, words = languages_of(text, begin, stop)
    return found if words >= 3 else found | languages_of(text, 0, len(text))[0]


def blocks(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(start, first character after a list mark, end, whether it is code) of each block."""
    at, begin, body, number = 0, -1, -1, None
    fence, code = "", -1
    n = len(text)
    while at <= n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        line = text[at:end].rstrip("\r")
        blank = not line.strip(_WHITE)
        if fence:
            if line.strip(" \t") == line.strip(" \t")[:1] * len(line.strip(" \t")) and line.strip(" \t").startswith(fence):
                yield code, code, end, True
                fence, code = "", -1
            elif end == n:
                yield code, code, n, True
                fence, code = "", -1
        else:
            opened = _FENCE.match(line)
            indented = not blank and line.startswith(("\t", "    "))
            if code >= 0 and not indented:
                yield code, code, at, True
                code = -1
            item = None if opened or indented or blank else _ITEM.match(line)
            if item and begin >= 0:
                # Directly after other lines a number begins an item only if it begins a list or goes on with one: it may be a wrapped ordinal.
                if item[2] and int(item[2]) != (1 if number is None else number + 1):
                    item = None
            if begin >= 0 and (blank or opened or indented or item):
                yield begin, body, at, False
                begin = -1
            if blank:
                number = None
            elif opened:
                fence, code = opened[1], at
                if end == n:
                    yield code, code, n, True
                    fence, code = "", -1
            elif indented:
                code = at if code < 0 else code
            elif item:
                begin, body = at, at + item.end()
                number = int(item[2]) if item[2] else None
            elif begin < 0:
                begin = body = at
        at = end + 1
    if code >= 0:
        yield code, code, n, True
    if begin >= 0:
        yield begin, body, n, False


def _goes_on(text: str, start: int, opening: int, at: int, stop: int) -> bool:
    """Whether the sentence from ``start`` goes on after a quotation in it, text[opening:at]: in lower case, or, where all is in capitals or
    title case, so that case tells nothing, with a word that goes on."""
    word = _WORD_THERE.match(text, at, stop)
    if word is None:
        return False
    if word[1][0].islower() or _SPEAKER.match(text, at, stop):
        return True
    if _LOWER_WORD.search(text, start, at):
        return False
    return text[opening:at].isupper() and len(word[1]) > 1 and word[1].isupper() or word[1].lower() in GOING_ON


_LINE_ENDS = ("", "\n", "\r")


def _after_mark(text: str, start: int, at: int, stop: int) -> int:
    """The end of the closing quotes, brackets and emoji that follow a mark; what also opens quotations counts only where one is open."""
    if text[at : at + 1] in _LINE_ENDS or text[at] == " " and " " < text[at + 1 : at + 2] < "\xa0":
        return at  # nothing of these follows: the most frequent case
    while True:
        end = _AFTER.match(text, at, stop).end()
        if text[end : end + 1] == "“" and end < stop and text.rfind("„", start, end) > text.rfind("“", start, end):
            at = end + 1
            continue
        spaced = end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip(" \xa0\u202f"))
        if text[spaced : spaced + 1] == "»" and end < spaced < stop and text.rfind("«", start, end) > text.rfind("»", start, end):
            at = spaced + 1
            continue
        if text[at - 1 : at] in tuple(CLOSE) and (quote := text.find('"', at, end)) >= 0 and text.count('"', start, quote) % 2 == 0:
            return quote
        return end


@lru_cache(maxsize=8)
def _names(text: str) -> frozenset[str]:
    """Names that end with a mark, known as such by a place inside a sentence: ``mail from Yahoo! for``."""
    return frozenset(_NAME_INSIDE.findall(text))


def _decide(text: str, body: int, mark: int, mark_end: int, end: int, stop: int, languages: Callable[[], frozenset[str]]) -> bool:
    last = text[mark_end - 1]
    if last != "." or mark_end - mark > 1 or end == stop or not text[end].isspace():  # else none of these matches: the most frequent case
        for r in _FIRST[last if mark_end - mark == 1 else last * 2]:
            if r.before.match(text, body, mark_end) and r.after.match(text, end, stop):
                return r.breaks
    if last == "!" and (name := _NAME_THERE.match(text, body, mark_end)) and _LOWER_NEXT.match(text, end, stop) and name[0] in _names(text):
        return False
    if last != "." or not _GATE.match(text, body, mark_end):  # all rules of the other tables stand behind a full stop
        return True
    return next(r.breaks for r in cascade(languages()) if r.before.match(text, body, mark_end) and r.after.match(text, end, stop))


def prose_ends(text: str, body: int, stop: int, languages: Callable[[], frozenset[str]] = frozenset) -> Iterator[int]:
    """The ends of the units in text[body:stop], but for the last."""
    start, at, passed = body, body, -1
    # Addresses, without the marks at their ends, which may be those of the sentence.
    addresses = [(m.start(), m.start() + len(m[0].rstrip(".,;:!?…'\")”»"))) for m in _ADDRESS.finditer(text, body, stop)] if "://" in text or "@" in text else []
    seek = (_NEXT_THAI if _THAI_LETTER.search(text, body, stop) else _NEXT).search
    while (found := seek(text, at, stop)) is not None:
        at = found.start()
        while addresses and addresses[0][1] <= at:
            del addresses[0]
        if addresses and addresses[0][0] <= at:
            at = passed = addresses[0][1]
            continue
        c = text[at]
        if c == "'" and at > body and text[at - 1].isalpha():
            at += 1  # an apostrophe
            continue
        m = (_MARK if c in _MARKS else _SPANS).match(text, at, stop)
        if m is None:
            at += 1
            continue
        at = m.end()
        kind = m.lastgroup
        if kind == "code":
            continue
        if kind == "thai":
            yield m.start()
            start = m.end()
            continue
        if kind == "span":
            opening, after = m.start(), _BLANKS.match(text, at, stop).end()
            ended = _ENDED.search(m[0][:-1]) is not None
            first = not text[start:opening].strip(_WHITE)
            quoted = m[0][0] not in _PARENTHESES
            follows = text[after : min(stop, after + 1)]
            goes_on = _goes_on(text, start, opening, at, stop)
            if first and ended and (not quoted or not (goes_on or follows in tuple(",;:–—、，；：とはがをにのも"))):
                at = opening + 1  # stands for itself: its sentences are units
                continue
            if not (ended and quoted):
                continue
            spaced = after > at
            introduced = text[start:opening].rstrip(_WHITE)[-1:] in (":", "：")
            if after == stop or not (spaced or introduced and m[0][0] in "“「『") or follows in tuple(",;:–—") or goes_on and not introduced:
                continue
            end = _after_mark(text, start, at, stop)
            if first and goes_on:
                continue
            yield end
            start = at = end
            continue
        end = _after_mark(text, start, at, stop)
        if _decide(text, max(body, passed) if passed == m.start() else body, m.start(), at, end, stop, languages):
            yield end
            start = end
            at = end
        elif end > at and text[at : at + 1] not in tuple("\"'“("):
            at = at + 1


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each unit of a text, in characters, white space at either end left out."""
    out: list[tuple[int, int]] = []
    if not text:
        return out

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        begin = a + len(piece) - len(piece.lstrip(_WHITE))
        end = begin + len(piece.strip(_WHITE))
        if end > begin:
            out.append((begin, end))

    for begin, body, stop, code in blocks(text):
        if code:
            add(begin, stop)
            continue
        start = begin
        for end in prose_ends(text, body, stop, lambda a=body, b=stop: _languages_in(text, a, b)):
            add(start, end)
            start = end
        add(start, stop)
    return out


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_char, end_char): one row for each sentence unit, in code points from 0, the end exclusive.

    NULL, empty and blank texts have no unit. Rows with a NULL key come out under NULL; repeated rows come out as often as they stand there.
    Texts are read whole, each by one task; nothing is shuffled. An empty input gives no rows. Other columns are ignored, whatever their names.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, starts, ends = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e in units(t):
                    index.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["key", "start_char", "end_char"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(split, f"key {rows.schema['key'].dataType.simpleString()}, start_char bigint, end_char bigint")
    return out.select(F.col("key").alias(key), "start_char", "end_char")
