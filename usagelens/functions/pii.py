"""Personal-data patterns and the checks that go with them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Pattern:
    """One kind of personal data.

    ``needs`` is a cheap test a text must pass before the regex can match at
    all; ``valid`` is an extra check on each match.
    """

    name: str
    tag: str
    regex: str
    needs: Callable[[Column], Column] | None = None
    valid: Callable[[Column], Column] | None = None


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    backwards = F.split(F.reverse(digits), "")
    # Every second digit from the right counts twice, minus nine above nine.
    weighted = F.transform(
        backwards,
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
            d.try_cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)
        ),
    )
    total = F.aggregate(weighted, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def _has(*parts: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        ok = F.contains(text, F.lit(parts[0]))
        for p in parts[1:]:
            ok = ok & F.contains(text, F.lit(p))
        return ok

    return test


def _any(*parts: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        ok = F.contains(text, F.lit(parts[0]))
        for p in parts[1:]:
            ok = ok | F.contains(text, F.lit(p))
        return ok

    return test


def _digit(text: Column) -> Column:
    return F.rlike(text, F.lit("[0-9]{3}"))


def _dotted(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[0-9]\.[0-9]"))


# ASCII word boundaries and ASCII white space, spelled out: the JVM's own \b and
# \s cover more characters.
_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_S = r" \t\n\f\r"

# Patterns, tags and their order.
DEFAULT_PATTERNS: tuple[Pattern, ...] = (
    Pattern(
        "url_credentials",
        "URL_CREDS",
        rf"""[a-zA-Z][a-zA-Z0-9+\-.]+://[^:@{_S}"']*:[^@{_S}"']+@[^{_S}"']+""",
        _has("://", "@"),
    ),
    Pattern(
        "api_key",
        "API_KEY",
        r"(?:sk-|pk_live_|pk_test_|sk_live_|sk_test_|rk_live_|rk_test_|ghp_|gho_|ghs_|ghr_"
        r"|glpat-|xoxb-|xoxp-)[A-Za-z0-9_\-]{16,}",
        _any("sk-", "_live_", "_test_", "ghp_", "gho_", "ghs_", "ghr_", "glpat-", "xox"),
    ),
    Pattern("email", "EMAIL", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", _has("@")),
    Pattern(
        "credit_card",
        "CREDIT_CARD",
        rf"{_B}[0-9]{{4}}[{_S}\-]?[0-9]{{4}}[{_S}\-]?[0-9]{{4}}[{_S}\-]?[0-9]{{4}}{_E}",
        _digit,
        luhn_valid,
    ),
    Pattern(
        "ssn", "SSN", rf"{_B}[0-9]{{3}}[-{_S}]?[0-9]{{2}}[-{_S}]?[0-9]{{4}}{_E}", _digit
    ),
    Pattern(
        "phone_us",
        "PHONE",
        rf"(?:\+1[{_S}\-.]?)?\(?[0-9]{{3}}\)?[{_S}\-.]?[0-9]{{3}}[{_S}\-.]?[0-9]{{4}}",
        _digit,
    ),
    Pattern(
        "ipv4",
        "IP_ADDRESS",
        rf"{_B}(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){{3}}"
        rf"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?){_E}",
        _dotted,
    ),
)


def patterns(disabled: Sequence[str] = (), extra: Sequence[Pattern] = ()) -> list[Pattern]:
    """Default patterns without the disabled names, then the extra ones."""
    off = {d.strip() for d in disabled}
    return [p for p in DEFAULT_PATTERNS if p.name not in off] + list(extra)
