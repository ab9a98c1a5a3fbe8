"""Text expressions. All are built-in column functions; whole texts are processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stance lexicon, the anonymised names and the keyword groups.
BULL_WORDS = (
    "buy bought long bull bullish breakout upside rally rip moon strong strength beat beats raise upgrade "
    "outperform undervalued support bounce squeeze positive add adding"
).split()
BEAR_WORDS = (
    "sell sold short bear bearish breakdown downside crash crushed fraud bubble weak weakness miss misses "
    "downgrade underperform overvalued resistance lawsuit probe investigation warning caution risk negative "
    "avoid scam bankrupt"
).split()
TICKERS = "AAPL MSFT NVDA TSLA AMZN META GOOGL AMD MSTR COIN HOOD PLTR SPY QQQ BTC ETH SOL".split()
COMPANY_NAMES = (
    "Apple Microsoft Nvidia Tesla Amazon Facebook Meta Google Alphabet MicroStrategy Coinbase Robinhood "
    "Palantir Bitcoin Ethereum Solana"
).split()
KEYWORD_GROUPS = {
    "earnings": ["earnings", "eps", "revenue", "guidance", "quarter"],
    "options": ["option", "calls", "puts", "flow", "strike"],
    "analyst": ["upgrade", "downgrade", "price target", "pt", "rating"],
    "macro": ["fed", "cpi", "inflation", "rates", "jobs"],
    "crypto": ["etf", "halving", "staking", "wallet", "chain", "defi"],
    "ai": [" ai ", "gpu", "chips", "datacenter", "model"],
    "legal": ["sec", "lawsuit", "court", "probe", "investigation"],
    "trade": ["breakout", "support", "resistance", "long", "short"],
}

# Unicode whitespace and word classes, spelled so that Java and RE2 read them alike.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NOT_SPACE = r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _hits(text: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def stance(c: Column | str) -> Column:
    """1 when more bullish than bearish words occur (as substrings), -1 for the reverse, else 0.

    URLs and @mentions are removed from the lower-cased text first; each word counts once.
    """
    lower = F.lower(_text(c))
    marked = F.contains(lower, F.lit("@")) | F.contains(lower, F.lit("://"))  # most texts skip the pattern
    lowered = F.when(marked, F.regexp_replace(lower, f"https?://{NOT_SPACE}+|@{WORD}+", " ")).otherwise(lower)
    return F.sign(_hits(lowered, BULL_WORDS) - _hits(lowered, BEAR_WORDS)).cast("int")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def clean_text(c: Column | str, limit: int | None = None) -> Column:
    """The lookup key of a text: URLs dropped, whitespace squeezed; the whole text unless a ``limit`` of characters is given."""
    whole = squeeze(F.regexp_replace(_text(c), f"https?://{NOT_SPACE}+", ""))
    return whole if limit is None else F.substring(whole, 1, limit)


def anonymize(
    c: Column | str, tickers: list[str] = TICKERS, names: list[str] = COMPANY_NAMES, limit: int | None = None
) -> Column:
    """Replace URLs, handles, cashtags, tickers and company names by placeholders, in the whole text unless a ``limit`` is given."""
    t = F.regexp_replace(_text(c), f"https?://{NOT_SPACE}+", " <URL> ")
    t = F.regexp_replace(t, r"@[A-Za-z0-9_]+", "<USER>")
    t = F.regexp_replace(t, r"\$[A-Za-z][A-Za-z0-9._-]*", "<ASSET>")
    for group in (tickers, names):
        t = F.regexp_replace(t, r"(?i)\b(?:" + "|".join(group) + r")\b", "<ASSET>")
    return squeeze(t) if limit is None else F.substring(squeeze(t), 1, limit)


SURFACE_NAMES = [
    "log_chars", "log_tokens", "upper_ratio", "n_cashtags", "n_hashtags", "n_mentions", "n_urls", "n_numbers",
    "has_question", "has_exclaim", "has_percent", "contains_sym",
] + [f"kw_{g}" for g in KEYWORD_GROUPS]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def surface_features(c: Column | str, sym: Column | str) -> dict[str, Column]:
    """Twenty counts and flags of a text, by name."""
    raw = _text(c)
    lower = F.lower(raw)
    padded = F.concat(F.lit(" "), lower, F.lit(" "))
    sym_c = F.lower(F.col(sym) if isinstance(sym, str) else sym)
    letters = _count(raw, r"\p{L}")
    out = {
        "log_chars": F.log1p(F.length(raw).cast("double")),
        "log_tokens": F.log1p(_count(raw, r"[A-Za-z0-9_$#%]+")),
        "upper_ratio": _count(raw, r"\p{Lu}") / F.greatest(F.lit(1.0), letters),
        "n_cashtags": _count(raw, r"\$[A-Za-z][A-Za-z0-9_]*"),
        "n_hashtags": _count(raw, r"#[A-Za-z][A-Za-z0-9_]*"),
        "n_mentions": _count(raw, r"@[A-Za-z][A-Za-z0-9_]*"),
        "n_urls": _count(raw, f"https?://{NOT_SPACE}+|www\\.{NOT_SPACE}+"),
        "n_numbers": _count(F.regexp_replace(raw, r"[A-Za-z]+[0-9]+(?:\.[0-9]+)?", " "),
                            r"[-+]?[0-9]+(?:\.[0-9]+)?%?"),
        "has_question": _flag(F.contains(raw, F.lit("?"))),
        "has_exclaim": _flag(F.contains(raw, F.lit("!"))),
        "has_percent": _flag(F.contains(raw, F.lit("%"))),
        "contains_sym": _flag(F.regexp_like(
            lower, F.concat(F.lit(r"(^|[^a-z])\$?"), sym_c, F.lit(r"([^a-z]|$)")))),
    }
    for g, words in KEYWORD_GROUPS.items():
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(padded, F.lit(w))
        out[f"kw_{g}"] = _flag(cond)
    return out


def symbol_onehot(sym: Column | str, symbols: list[str]) -> Column:
    c = F.col(sym) if isinstance(sym, str) else sym
    return F.array(*[_flag(c == s) for s in symbols])


def model_slug(c: Column | str) -> Column:
    t = F.regexp_replace(F.trim(_text(c)), r"[^A-Za-z0-9._-]+", "__")
    return F.lower(F.regexp_replace(t, r"^_+|_+$", ""))


def rounded(c: Column, digits: int = 3) -> Column:
    """Half-even rounding; NaN and infinities become NULL."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, F.bround(c, digits))


def content_key(payload: Column) -> Column:
    """sha1 of the compact JSON of a struct whose fields are in name order; NULL fields are kept."""
    return F.sha1(F.to_json(payload, {"ignoreNullFields": "false"}))
