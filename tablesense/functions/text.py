"""Words of a text, folded and stemmed so that question and text meet in the same form."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, functions as F

# Words without meaning for a search, in the two languages questions come in.
STOPWORDS_ENGLISH = (
    "a about all and any are as at average be between but by can count did do does each every "
    "for from get give group has have how in into is it its last list many me most much my no "
    "not of on one only or our per show since some sum that the their there they this to top "
    "total us was we were what when where which who why with year you"
).split()
STOPWORDS_ROMANIAN = (
    "acea aceasta acest aceste acesti acum ai al ale alta alte am arata asta astea atat atatea "
    "au avem care cat cata cate cati catre ce cea cele cine cu cum da dar de din doar dupa ei el "
    "era este eu fara fi fie fiecare fost ii il imi intre isi la le lor lui mai mea mi mult multe "
    "multi ne ni noi nostru nu numai o pe pentru peste pot poti prin sa sau se si spune sub sunt "
    "te toate tot toti un una unde unei unor unu va vor vrea"
).split()
# Inflection endings, the longest first.
ENDINGS = ("urilor", "elor", "ilor", "uri", "ile", "ele", "lui", "ii", "ul", "es", "s", "i", "e")
# Words that show a question is about errors or logs.
LOG_WORDS = (
    "error errors log logs logging exception exceptions failure failures audit incident incidents "
    "severity stacktrace eroare erori eroril jurnal loguri esec esecuri exceptie exceptii auditul"
).split()
# The business words the two languages share.
SYNONYMS = (
    ("cont", "account"), ("client", "customer"), ("tranzactie", "transaction"),
    ("comision", "fee"), ("taxa", "charge"), ("imprumut", "loan"), ("credit", "loan"),
    ("restanta", "arrears"), ("intarziere", "overdue"), ("sold", "balance"),
    ("dobanda", "interest"), ("plata", "payment"), ("factura", "invoice"),
    ("angajat", "employee"), ("departament", "department"), ("salariu", "salary"),
    ("comanda", "order"), ("produs", "product"), ("furnizor", "supplier"),
    ("adresa", "address"), ("tara", "country"), ("oras", "city"), ("moneda", "currency"),
    ("suma", "amount"), ("pret", "price"), ("cantitate", "quantity"), ("stoc", "stock"),
    ("utilizator", "user"), ("alerta", "alert"), ("sucursala", "branch"), ("filiala", "branch"),
    ("scadenta", "maturity"), ("rambursare", "repayment"), ("retragere", "withdrawal"),
    ("depunere", "deposit"), ("extras", "statement"), ("garantie", "collateral"),
    ("stare", "status"), ("nume", "name"), ("rol", "role"), ("contract", "contract"),
    ("card", "card"), ("banca", "bank"),
)
_STOPWORDS = frozenset(STOPWORDS_ENGLISH) | frozenset(STOPWORDS_ROMANIAN)
_ENDING = rf"^(.{{4,}}?)(?:{'|'.join(ENDINGS)})$"


@cache
def _fold_table() -> tuple[str, str]:
    """Letters to replace and their plain forms; combining marks come last and are dropped."""
    accented, plain, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        first, *rest = unicodedata.normalize("NFD", char)
        if "a" <= first <= "z" and rest and all(map(unicodedata.combining, rest)):
            accented.append(char)
            plain.append(first)
    return "".join(accented + marks), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without accents; plain ASCII texts skip the letter lookup."""
    source, target = _fold_table()
    lower = F.lower(text)
    return F.when(lower.rlike(r"[^\x00-\x7f]"), F.translate(lower, source, target)).otherwise(lower)


def _without_ending(word: Column) -> Column:
    """Drop the longest ending that leaves four letters. The last letter tells which can apply."""
    size, last = F.length(word), F.right(word, F.lit(1))
    shortened = None
    for letter in sorted({e[-1] for e in ENDINGS}):
        rest = None
        for ending in (e for e in ENDINGS if e[-1] == letter):
            fits = F.endswith(word, F.lit(ending)) & (size >= len(ending) + 4)
            step = (fits, F.left(word, size - len(ending)))
            rest = F.when(*step) if rest is None else rest.when(*step)
        step = (last == letter, rest.otherwise(word))
        shortened = F.when(*step) if shortened is None else shortened.when(*step)
    return shortened.otherwise(word)


def stem(word: Column) -> Column:
    """Drop up to three endings, never going below four letters."""
    rounds = F.array(F.lit(1), F.lit(2), F.lit(3))
    inflected = F.right(word, F.lit(1)).isin(*sorted({e[-1] for e in ENDINGS})) & (F.length(word) > 4)
    return F.when(inflected, F.aggregate(rounds, word, lambda w, _: _without_ending(w))).otherwise(word)


def _stems(words: Column) -> Column:
    # Distinct before stemming: a long text repeats few words many times.
    kept = F.filter(
        F.array_distinct(words), lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(_STOPWORDS))
    )
    return F.array_distinct(F.transform(kept, stem))


def content_words(text: Column) -> Column:
    """The distinct stems of the meaningful words of a text or identifier."""
    return _stems(F.regexp_extract_all(fold(text), F.lit("[a-z][a-z0-9]*"), F.lit(0)))


def asked_words(text: Column, stems: Sequence[str]) -> Column:
    """Those of ``content_words`` that begin like one of ``stems``.

    A stem is the beginning of its word, so only such words have to be taken out and stemmed.
    """
    beginnings = "|".join(re.escape(s) for s in stems)
    words = F.lit(rf"(?<![a-z0-9])[0-9]*((?:{beginnings})[a-z0-9]*)")
    return _stems(F.regexp_extract_all(fold(text), words, F.lit(1)))


def stem_word(word: str) -> str:
    """The rule of :func:`stem` for one word of a question, which lives on the driver.

    The stem is matched lazily, so the longest ending that leaves four letters wins.
    """
    for _ in range(3):
        word = re.sub(_ENDING, r"\1", word)
    return word


def question_words(question: str) -> list[str]:
    """Stems of a question and their equivalents in the other language."""
    lowered = unicodedata.normalize("NFD", question.lower())
    plain = "".join(c for c in lowered if not unicodedata.combining(c))
    words = {
        stem_word(w)
        for w in re.findall("[a-z][a-z0-9]*", plain)
        if len(w) >= 3 and w not in _STOPWORDS
    }
    groups = [{stem_word(a), stem_word(b)} for a, b in SYNONYMS]
    return sorted(words.union(*(g for g in groups if g & words)))


def asks_about_logs(words: list[str]) -> bool:
    return not {stem_word(w) for w in LOG_WORDS}.isdisjoint(words)
