"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the characters and cues that personal data cannot do without: at-signs, digits, plus
signs before digits, schemes, and words that announce accounts. Around each anchor a small parser expands to the
boundaries of an address or number and validates it. Text without anchors is never parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from chalkline.llm.batches import with_text_columns

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account")
BASE = 4

# Characters and patterns of the base kinds, and the words that announce an account.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_RUN, IP = re.compile(r"[0-9.]+"), re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD_RUN, CARD = re.compile(r"[0-9\x20-]+"), re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^\s/@:]+):([^\s/@]+)@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[\s:#-]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\s?(?:no|nr|number|num)\.?)?[\s:#-]{1,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.I)
CUES = ("account", "acct", "konto", "cuenta", "compte")
SCHEMES = ("://",)

Span = tuple[int, int, int]  # start, kind, end


@cache
def automaton():
    """The anchors, each with the parser it calls for."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for d in "0123456789":
        out.add_word(d, ("number", 1))
        out.add_word("+" + d, ("phone", 2))
    out.add_word("@", ("email", 1))
    for s in SCHEMES:
        out.add_word(s, ("login", len(s)))
    for cue, parser in [("iban", "iban"), *((c, "account") for c in CUES)]:
        for form in (cue, cue.upper(), cue.capitalize()):
            out.add_word(form, (parser, len(form)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def spans(text: str) -> list[Span]:
    """All spans of a text. Base kinds are leftmost and non-overlapping per kind: what a failing match covers
    is not tried again."""
    out: list[Span] = []
    done = dict.fromkeys(("email", "ip", "card", "phone"), 0)
    for last, (parser, width) in automaton().iter(text):
        at = last - width + 1
        if parser == "number":
            if at >= done["ip"]:
                done["ip"] = IP_RUN.match(text, at).end()
                for m in IP.finditer(text, at, done["ip"]):
                    if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
                        out.append((m.start(), 1, m.end()))
            if at >= done["card"]:
                done["card"] = CARD_RUN.match(text, at).end()
                for m in CARD.finditer(text, at, done["card"]):
                    digits = _digits(m.group())
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((m.start(), 2, m.end()))
        elif parser == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
        elif parser == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                out.append((start, 0, m.end()))
        elif parser == "login":
            start = at
            while start > 0 and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "+.-"):
                start -= 1
            if m := LOGIN.match(text, start):
                out.append((m.start(), 4, m.end()))
        elif parser == "iban":
            if (m := IBAN.match(text, at + width)) and mod97(m.group(1).replace(" ", "")):
                out.append((m.start(1), 5, m.end(1)))
        elif m := ACCOUNT.match(text, at + width):
            out.append((m.start(1), 6, m.end(1)))
    return sorted(set(out))


def written_spans(found: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def with_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_spans and spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, joined by commas; the further kinds
    are logins inside addresses, IBANs and account numbers after a cue. A null or empty text has none. Rows are
    neither dropped nor merged; existing columns of these names are replaced.
    """
    fields = [StructField(f"n_{k}", LongType()) for k in KINDS[:BASE]]
    fields += [StructField(n, StringType()) for n in ("base_spans", "spans")]

    def make():
        def work(texts: list[str]):
            out = [[] for _ in fields]
            for t in texts:
                every = spans(t)
                base = [s for s in every if s[1] < BASE]
                kinds = [k for _, k, _ in base]
                values = [*(kinds.count(k) for k in range(BASE)), written_spans(base), written_spans(every)]
                for column, value in zip(out, values):
                    column.append(value)
            return out

        return work

    return with_text_columns(docs, fields, make, text)
