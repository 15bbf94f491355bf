"""What is shaped like a person's or an organisation's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rx
from ..functions.policy import DEFAULT, Policy
from ..functions.scalars import WORD_BEGINS, among, begins_any, collapsed, contains_any, let, stripped, tokens, words

# Patterns of names, organisations and roles.
NAME_TOKEN = r"(?:[A-Z][a-z'\-]{1,20}|[A-Z]{2,20})"
CONNECTOR = "(?:and|of|for|&|the)"
INITIAL = r"^[A-Z]\.?$"
CANDIDATE = rf"\b{NAME_TOKEN}(?:\s+{NAME_TOKEN}){{1,3}}\b"
MAX_CONTEXT_BLOCK = 90
PROXIMITY = 250
SUFFIX_REACH = 45


def honorific_pattern(policy: Policy = DEFAULT) -> str:
    return rf"(?U)\b(?i:{rx.any_of(policy.honorifics, True)})\s+((?:{NAME_TOKEN}\s+){{0,3}}{NAME_TOKEN})\b"


def org_pattern(policy: Policy = DEFAULT) -> str:
    return rf"(?U)\b((?:(?:{NAME_TOKEN}|{CONNECTOR})[\s&.\-]+){{1,8}}(?i:{rx.any_of(policy.strong_suffixes, True)}))\b"


def name_role_pattern(policy: Policy = DEFAULT) -> str:
    return rf"(?U)({NAME_TOKEN}(?:\s+{NAME_TOKEN}){{1,3}})\s*,\s*(?i:(?:[A-Za-z\-]+\s+){{0,2}}(?:{rx.any_of(policy.keywords)}))"


def label_pattern(policy: Policy = DEFAULT) -> str:
    return rf"(?Us){WORD_BEGINS}(?i:{rx.any_of(policy.keywords)})\s*[:\-]\s*(.{{5,400}})"


def blocked_tokens(policy: Policy = DEFAULT) -> tuple[str, ...]:
    markers = tuple(m for m in policy.address_markers if " " not in m and "." not in m)
    return tuple(dict.fromkeys((*policy.non_person, *policy.more_non_person, *policy.function_words, *markers, *policy.org_indicators)))


def is_name_like(phrase: Column, policy: Policy = DEFAULT) -> Column:
    """Two to four tokens, of which none is jargon and not all are initials."""
    blocked = words(blocked_tokens(policy))

    def sound(t: Column) -> Column:
        bare = F.lower(stripped(t, ".,'&"))
        letters = (F.length(bare) >= 2) & F.replace(bare, F.lit("'"), F.lit("")).rlike(r"^\p{L}+$")
        return t.rlike(INITIAL) | (letters & ~F.array_contains(blocked, bare))

    parts = F.filter(F.split(phrase, r"(?U)[\s\-]+"), lambda t: t != "")
    return let(parts, lambda p: F.size(p).between(2, 4) & F.forall(p, sound) & F.exists(p, lambda t: ~t.rlike(INITIAL)))


def longest_name(phrase: Column, policy: Policy = DEFAULT) -> Column:
    """The longest run of two to four tokens that is name-like, the leftmost of equals; null if none is."""

    def best(parts: Column) -> Column:
        widths = F.filter(F.array(F.lit(4), F.lit(3), F.lit(2)), lambda w: w <= F.size(parts))
        runs = F.flatten(
            F.transform(widths, lambda w: F.transform(F.sequence(F.lit(1), F.size(parts) - w + 1), lambda s: F.array_join(F.slice(parts, s, w), " ")))
        )
        return F.get(F.filter(runs, lambda r: is_name_like(r, policy)), F.lit(0))

    return let(tokens(phrase), best)


def has_person_context(text: Column, policy: Policy = DEFAULT) -> Column:
    return begins_any(text, policy.keywords)


def is_public_body(phrase: Column, policy: Policy = DEFAULT) -> Column:
    return among(F.trim(F.lower(phrase)), policy.public_bodies)


def is_legislation(phrase: Column, policy: Policy = DEFAULT) -> Column:
    return F.arrays_overlap(F.transform(tokens(phrase), lambda t: stripped(F.lower(t), ",.")), words(policy.legislation))


def trim_org_noise(phrase: Column, policy: Policy = DEFAULT) -> Column:
    """Without the leading words that are no part of a name."""
    noise, parts = words(policy.org_noise), tokens(phrase)
    first = F.get(
        F.filter(
            F.transform(parts, lambda t, i: F.when(~F.array_contains(noise, F.lower(stripped(t, ",.&-"))), i)),
            lambda i: i.isNotNull(),
        ),
        F.lit(0),
    )
    return F.when(first.isNull(), "").otherwise(F.array_join(F.slice(parts, first + 1, F.size(parts)), " "))


def is_org_like(phrase: Column, policy: Policy = DEFAULT) -> Column:
    """Is what stands before the legal suffix more than jargon?"""
    # the leftmost of the suffixes that end the phrase is the longest
    suffix = F.regexp_extract(F.lower(phrase), f"(?:{rx.any_of(policy.strong_suffixes)})$", 0)
    size = F.greatest(F.size(F.split(suffix, " ")), F.lit(1))
    parts = F.filter(F.transform(tokens(phrase), lambda t: F.lower(stripped(t, ",.&-"))), lambda t: t != "")
    jargon, generic = words((*policy.org_stopwords, *policy.function_words)), words(policy.generic_heads)

    def telling(head: Column) -> Column:
        last = F.get(head, F.size(head) - 1)
        return (
            (F.size(head) > 0)
            & ~F.coalesce(F.array_contains(jargon, last), F.lit(False))
            & ~((F.size(head) == 1) & F.coalesce(F.array_contains(generic, last), F.lit(False)))
            & F.exists(head, lambda t: ~F.array_contains(jargon, t))
        )

    # a phrase of one token, or of no more than the suffix, has no head
    return let(parts, lambda p: let(F.slice(p, 1, F.greatest(F.size(p) - size, F.lit(0))), telling))


def org_phrase(raw: Column, policy: Policy = DEFAULT) -> Column:
    return trim_org_noise(stripped(collapsed(raw), " ,.&-"), policy)


def is_company(phrase: Column, policy: Policy = DEFAULT) -> Column:
    return ~is_public_body(phrase, policy) & ~is_legislation(phrase, policy) & is_org_like(phrase, policy)


def strip_suffix(phrase: Column, policy: Policy = DEFAULT) -> Column:
    """Without its longest suffix; null if it has none."""
    end = f"(?i) (?:{rx.any_of(policy.org_suffixes)})$"
    return F.when(phrase.rlike(end), stripped(F.regexp_replace(phrase, end, ""), " ,.&-"))


def looks_like_org(tail: Column, policy: Policy = DEFAULT) -> Column:
    return contains_any(F.lower(tail), policy.org_suffixes)


def keyword_is_near(phrase: Column, context: Column, policy: Policy = DEFAULT) -> Column:
    """Some role keyword begins a word within PROXIMITY of the phrase's first place in the context; true where it has none."""
    reach = max(map(len, policy.keywords), default=0)
    role = f"{WORD_BEGINS}(?i:{rx.any_of(policy.keywords)})"
    # the one letter that is two code points in lower case
    context = F.translate(context, "İ", "I")

    def near(at: Column) -> Column:
        start = F.greatest(at - PROXIMITY, F.lit(0))
        window = rx.window_of(context, start, at + PROXIMITY + reach)
        # the first such place is the nearest to the window's begin: if it is too far, all are
        parts = F.split(window, role, 2)
        return (at < 0) | let(parts, lambda p: (F.size(p) > 1) & (F.length(F.get(p, F.lit(0))) - 1 + start <= at + PROXIMITY))

    return let(F.call_function("locate", F.lower(phrase), F.lower(context)) - 1, near)


def name_from_email(local: Column, policy: Policy = DEFAULT) -> Column:
    """First.last as a name; null for role mailboxes and single words."""
    parts = F.filter(F.split(F.regexp_replace(local, r"\d+$", ""), r"[._\-]+"), lambda p: p != "")
    good = (F.size(parts) >= 2) & ~F.exists(parts, lambda p: among(F.lower(p), policy.role_mailboxes)) & F.forall(parts, lambda p: p.rlike(r"^\p{L}{2,}$"))
    return F.when(good, F.array_join(F.transform(parts, lambda p: F.initcap(F.lower(p))), " "))
