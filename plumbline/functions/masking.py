"""Detection patterns and masks for personal data, as native column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds in detection order with their Korean labels.
KIND_LABELS = {
    "name": "이름",
    "email": "이메일",
    "phone": "전화번호",
    "resident_id": "주민번호",
    "address": "주소",
    "card": "카드/계좌",
}

# Column-name patterns, first hit wins.
NAME_PATTERNS = {
    "name": "name|이름|성명",
    "email": "email|이메일|메일",
    "phone": "phone|tel|전화|연락처|휴대폰",
    "resident_id": "ssn|주민번호|주민등록",
    "address": "address|addr|주소",
    "card": "card|카드|계좌|account",
}

# Value patterns, first hit wins.
VALUE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"0\d{1,2}[-.\s]?\d{3,4}[-.\s]?\d{4}",
    "resident_id": r"\d{6}[-\s]?[1-4]\d{6}",
    "card": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
}

# The value patterns again, with the characters that stay visible captured.
TEXT_MASKS = {
    "email": (
        r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})",
        "$1***@$2",
    ),
    "phone": (
        r"0(\d)(?:(\d)[-.\s]?\d{3,4}|[-.\s]?(\d)\d{2,3})[-.\s]?(\d{4})",
        "0$1$2$3-****-$4",
    ),
    "resident_id": (r"(\d{6})[-\s]?[1-4]\d{6}", "$1-*******"),
    "card": (r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?(\d{4})", "****-****-****-$1"),
}

HIDDEN = "***"
NUMBER_SIGN = r"\d{4}"  # part of every phone, resident id and card number


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_kind(name: str) -> str | None:
    """Kind suggested by a column name."""
    return next((k for k, p in NAME_PATTERNS.items() if re.search(p, name, re.IGNORECASE)), None)


def matches_kind(value: Column | str, kind: str) -> Column:
    """True when the whole value looks like `kind`."""
    return _col(value).rlike(f"^{VALUE_PATTERNS[kind]}$")


def mask_value(value: Column | str, kind: str) -> Column:
    """Mask one value of a known kind; NULL stays NULL."""
    v = _col(value).cast("string")
    if kind == "email":
        at = F.instr(v, "@")
        domain = F.substring(v, at + 1, F.length(v))
        masked = F.when(
            at > 0, F.concat(F.substring(v, 1, F.least(at - 1, F.lit(1))), F.lit("***@"), domain)
        )
    elif kind == "phone":
        d = F.regexp_replace(v, r"\D", "")
        masked = F.when(
            F.length(d) >= 7, F.concat(F.substring(d, 1, 3), F.lit("-****-"), F.right(d, F.lit(4)))
        )
    elif kind == "resident_id":
        d = F.regexp_replace(v, r"[-\s]", "")
        masked = F.when(F.length(d) >= 6, F.concat(F.substring(d, 1, 6), F.lit("-*******")))
    elif kind == "card":
        d = F.regexp_replace(v, r"\D", "")
        masked = F.when(
            F.length(d) >= 4, F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))
        )
    elif kind == "name":
        stars = F.greatest(F.length(v) - 1, F.lit(1))
        masked = F.when(
            F.length(v) > 0, F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), stars))
        )
    else:
        masked = F.lit(None).cast("string")
    return F.when(v.isNotNull(), F.coalesce(masked, F.lit(HIDDEN)))


def mask_text(text: Column | str, longest_first: bool = False) -> Column:
    """Mask every e-mail, phone, resident id and card number inside free text.

    The default order lets the phone pattern eat digits of longer numbers;
    `longest_first` masks card and resident numbers before phones.
    """
    text = _col(text)
    numbers = ["card", "resident_id", "phone"] if longest_first else ["phone", "resident_id", "card"]

    def masked(c: Column, kind: str) -> Column:
        return F.regexp_replace(c, *map(F.lit, TEXT_MASKS[kind]))

    # most texts have neither sign, and both are far cheaper to look for than the patterns
    mailed = F.when(F.contains(text, F.lit("@")), masked(text, "email")).otherwise(text)
    return F.when(text.rlike(NUMBER_SIGN), reduce(masked, numbers, mailed)).otherwise(mailed)
