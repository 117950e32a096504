"""Selection of ticket-shaped rows: who is asked, what is wrong, whom the text addresses."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.language import SCRIPTS, UNSURE, guess_language
from ticketloom.functions.text import strip

# Bounds of a ticket.
MIN_CHARS, STARS, WINDOW_DAYS = 120, (1, 2, 3, 4), 365
MAX_INPUT = 12_000
MAIN_LANGUAGES = (UNSURE, "es", "pt", "fr", "de", "tr")

# A request. Stems take any ending, phrases are whole words.
ASK_STEMS = "refund rembours reembols erstatt zwrot iade restitui cancel annul cancelar k[üu]ndig stornier anular iptal solicit reclam"
ASK_PHRASES = [
    r"please (help|fix|stop|explain|check|refund|cancel)\w*", r"i (want|need|demand|expect|request)\b", r"(can|could) you\b", r"how (do|can) i\b", r"why (was|am|did|is) i\b",
    r"(quiero|necesito|exijo|por favor)\b", r"je (veux|demande|souhaite)\b", r"bitte\b", r"ich (will|fordere|bitte)\b", r"(voglio|chiedo|quero|prosz[ęe]|l[üu]tfen|talep)\w*",
]
# A concrete fault.
FAULT_STEMS = "charg cobr pr[ée]l[èe]v preleva abbuch belast debit deduct fail error crash freez glitch"
FAULT_PHRASES = [
    r"(can'?t|cannot|unable|won'?t|does ?n'?t|did ?n'?t|is ?n'?t)\b", r"not work\w*", r"bugs?\b", r"never (got|received|worked|arrived|came)\b", r"no (reply|response|answer)\b",
    r"(wrong|incorrect|missing|stuck|blocked|locked)\b",
]
FAULT_ANYWHERE = ["no puedo", "no funciona", "ne (fonctionne|marche) pas", "funktioniert nicht"]
# The company is spoken to. {brand} is its name.
ADDRESS_PHRASES = [
    r"you (guys |people |lot )?(charged|took|billed|deducted|stole|scam\w*|have taken|are charging|keep charging|owe|need to|should|must)\b", r"your (app|team|support|company|website|service|system|customer)\b",
    r"please (refund|cancel|stop|help|fix|check|explain|confirm|remove|delete|send|contact|reply|respond)\w*", r"i (want|need|request|demand|expect|would like|am contacting|am writing)\b",
    r"refund me\b", r"give me (my|back|back my)\b", r"i am asking\b", r"my money back\b", r"how (do|can) i\b", r"why (was|am|did|is|are|have) (i|my)\b", r"can you\b", r"could you\b", r"kindly\b",
    r"dear ({brand}|support|team|sir|madam)\b", r"hello,? {brand}\b", r"{brand},? (please|you|i)\b", r"to {brand}\b",
    r"por favor\b", r"quiero que\b", r"necesito que\b", r"devuelvan\b", r"solicito\b", r"exijo\b", r"je (veux|demande|souhaite)\b", r"veuillez\b", r"rembours(ez|ement)\b",
    r"bitte\b", r"ich (fordere|verlange|m[öo]chte|bitte)\b", r"erstatten sie\b", r"teile ich ihnen mit\b", r"voglio\b", r"chiedo\b", r"rimborsate\b", r"restituite\b",
    r"quero\b", r"devolvam\b", r"aguardo o estorno\b", r"prosz[ęe]\b", r"l[üu]tfen\b", r"talep ediyorum\b", r"iade\b",
]
ADDRESS_ANYWHERE = [
    "прошу", "верните", "требую", "поверніть", "хочу вернуть", "верн[иу]те", "возврат", "отмен[иу]те", "скасуйте", "повернення", "επιστροφή", "ακύρωση", "ακυρώστε",
    "환불", "취소해", "해지", "돌려[주받]", "返金", "キャンセル", "解約", "返して", "退款", "取消订阅", "退訂", "退錢", "申請退",
    "استرداد", "إلغاء", "ارجاع", "أرجعوا", "ยกเลิก", "คืนเงิน", "ขอเงินคืน", "החזר", "ביטול", "להחזיר",
]
# A warning to other buyers, within the first 80 characters.
WARNINGS = [
    r"(do ?n'?t|do not) (download|install|use|waste|buy|get|trust)", "stay away", "avoid (this|it)", "beware", "buyer beware", "warning", "save your money",
    "no (lo )?descargu", "ne (le )?t[ée]l[ée]charg", "nicht herunterladen",
]
# Aggressive words, by their beginnings.
AGGRESSIVE = (
    "scam fraud thief thieves steal stole stolen liar lying rip[- ]?off crook disgusting shameful shame\\son pathetic useless garbage trash worst horrible awful outrageous unacceptable "
    "estafa ladr[óo]n robo robaron verg[üu]enza arnaque escroc vol[ée] honteux betrug abzocke dreist unversch[äa]mt truffa ladri vergogna roubo мошен обман ворю шахра dolandırıcı hırsız"
)


def _stems(words: str) -> str:
    return rf"\b({'|'.join(words.split())})\w*"


def _pattern(stems: str, phrases: list[str], anywhere: list[str]) -> str:
    parts = ([_stems(stems)] if stems else []) + ([rf"\b({'|'.join(phrases)})"] if phrases else []) + anywhere
    return "|".join(parts)


def patterns(brand: str) -> dict[str, str]:
    """The four patterns by name, without flags: ignore case, words in all scripts, a dot is any character."""
    address = [p.replace("{brand}", brand) for p in ADDRESS_PHRASES]
    return {
        "asks": _pattern(ASK_STEMS, ASK_PHRASES, []),
        "faulty": _pattern(FAULT_STEMS, FAULT_PHRASES, FAULT_ANYWHERE),
        "addressed": _pattern("", address, ADDRESS_ANYWHERE),
        "warns": rf"^.{{0,80}}?\b({'|'.join(WARNINGS)})",
        "aggressive": rf"\b({'|'.join(AGGRESSIVE.split())})",
    }


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?iusU){pattern}")


def cutoff(as_of: str, days: int = WINDOW_DAYS) -> Column:
    """The first day of the window before an explicit date; never from today's."""
    return F.date_sub(F.to_date(F.lit(as_of)), days)


def in_window(date: Column, as_of: str) -> Column:
    return F.coalesce(date.cast("date") >= cutoff(as_of), F.lit(False))


def gradable(text: Column, score: Column) -> Column:
    """Stars below the highest and text enough."""
    return F.coalesce(score.isin(*STARS) & (F.length(text) >= MIN_CHARS), F.lit(False))


def shape(text: Column, brand: str) -> dict[str, Column]:
    return {name: says(text, p) for name, p in patterns(brand).items()}


def is_ticket(date: Column, score: Column, text: Column, as_of: str, brand: str) -> Column:
    """Recent, gradable, asks for something, names a fault, speaks to the company and does not open as a warning."""
    s = shape(text, brand)
    return in_window(date, as_of) & gradable(text, score) & s["asks"] & s["faulty"] & s["addressed"] & ~s["warns"]


def non_latin(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(SCRIPTS.values())), F.lit(False))


def language_stream(date: Column, score: Column, text: Column, as_of: str) -> Column:
    """Recent gradable rows in another script or language; no word list is asked."""
    return in_window(date, as_of) & gradable(text, score) & (non_latin(text) | (F.coalesce(guess_language(text), F.lit(UNSURE)) != UNSURE))


def ticket_text(title: Column, body: Column) -> Column:
    """Title, blank line, body; without a title the body as it is."""
    head = strip(F.coalesce(title, F.lit("")))
    return F.when(head == "", body).otherwise(strip(F.concat(head, F.lit("\n\n"), F.coalesce(body, F.lit("")))))


def language_bucket(lang: Column) -> Column:
    return F.when(lang.isin(*MAIN_LANGUAGES), lang).otherwise("other_lang")


def accepted(text: Column) -> Column:
    """An input of 1 to MAX_INPUT characters; null is refused."""
    return F.coalesce(F.length(text).between(1, MAX_INPUT), F.lit(False))


def compatible(rows: DataFrame, text: str, out: str) -> DataFrame:
    """NFKC and single spaces, none at the ends; null gives the empty text."""

    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").split()))

    return rows.withColumn(out, fold(text))
