"""Rules over prompts and answers as column expressions: matches, routing, scoring, follow-ups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# What the rules look for.
STAGE_PATTERNS = [r"사이클\s*(\d+)", r"cycle\s*(\d+)", r"step\s*(\d+)", r"(\d+)\s*단계"]
GENERIC_SYMPTOMS = ["안", "왜", "뭐", "어떻게", "그", "이", "저", "게", "거", "것", "the", "a", "an", "is", "are", "what", "why", "how"]
INTENT_PATTERNS = [
    ("comparison", r"\bvs\b|차이|다른\s*점|어느\s*게\s*더|비교"),
    ("symptom", r"왜\s*안|에러|fail|문제|오류|이상해|안\s*돼|exception|bug"),
    ("deep-dive", r"어떻게\s*동작|원리|내부\s*구현|왜\s*그래|동작\s*과정|deep|internal"),
    ("definition", r"란\??$|이란|뭐야|뭐예요|무엇|뜻|개념|정의|what\s+is"),
]
DIFFICULTY_HINTS = [("beginner", r"초급|입문|기초|뭐야|뭐예요|primer|beginner"), ("advanced", r"심화|고급|advanced|expert|deep\s*dive")]
FOLLOW_UP = r"^\s*(이거|이건|그거|그건|그럼|그러면|그래서|아까|방금|왜(\s|$)|어떻게(\s|$))|^\s*(?i:this|that|then|so|why|how|what about|and then|example)\b"
DEPTH_MARKERS = ["왜냐하면", "이유는", "원리", "내부적으로", "반면", "대신", "trade-off", "트레이드오프", "비교하면", "차이점", "근본적으로", "보장", "불변식", "invariant", "because", "whereas", "internally", "under the hood", "fundamentally", "tradeoff", "in contrast"]
PRACTICAL_MARKERS = ["예를 들면", "실제로", "운영", "장애", "배포", "롤백", "성능", "테스트", "검증", "경계 조건", "엣지 케이스", "타임아웃", "재시도", "모니터링", "로그", "for example", "in practice", "production", "incident", "rollback", "edge case", "timeout", "retry", "monitoring", "benchmark"]
GIVING_UP = ["잘 모르", "모르겠", "패스", "pass", "skip"]
PHRASE_STOPLIST = ["and", "or", "the", "a", "an", "to", "of", "in", "on", "for"]


def count_of(hits: list[Column]) -> Column:
    return sum((F.coalesce(h, F.lit(False)).cast("long") for h in hits), F.lit(0).cast("long"))


def mentions(text: Column, word: str) -> Column:
    """An ASCII word as a whole word, whatever its case; any other as a part of the folded text."""
    if word.isascii():
        return text.rlike(rf"(?i)(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])")
    return F.lower(text).contains(word.lower())


def mentioned(text: Column, words: list[str]) -> Column:
    """How many of the words a text mentions."""
    return count_of([mentions(text, w) for w in words])


def held(text: Column, words: list[str]) -> Column:
    """How many of the words are parts of a text."""
    return count_of([text.contains(w) for w in words])


def compact_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and Hangul, one blank between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z가-힣]+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(compact_words(text), " ", "")


def stage_numbers(text: Column) -> Column:
    """Distinct stage numbers that a text names, sorted as text."""
    found = [F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(p), F.lit(1)) for p in STAGE_PATTERNS]
    out = found[0]
    for f in found[1:]:
        out = F.array_union(out, f)
    return F.sort_array(F.array_distinct(out))


def stage_variants(numbers: Column) -> Column:
    """The compact spellings of stage numbers."""
    forms = F.transform(numbers, lambda n: F.array(F.concat(F.lit("사이클"), n), F.concat(F.lit("cycle"), n), F.concat(F.lit("step"), n), F.concat(n, F.lit("단계"))))
    return F.sort_array(F.array_distinct(F.flatten(forms)))


def relevance(title: Column, body: Column, refs: Column, hint: str, stages: list[str], tokens: list[str], focus: list[str], keywords: list[str]) -> Column:
    """Points of a pull request for a mission: an exact hint, its stage, tokens, focus terms and keywords, each by the
    best place where it stands."""
    t, b, r = (compact_words(c) for c in (title, body, refs))
    tight = lambda c: F.regexp_replace(c, " ", "")
    total = F.lit(0).cast("long")
    if hint:
        total = total + F.when(tight(t).contains(hint), 20).when(tight(b).contains(hint), 8).otherwise(0)
    for v in sorted({f for n in stages for f in (f"사이클{n}", f"cycle{n}", f"step{n}", f"{n}단계")}):
        total = total + F.when(tight(t).contains(v), 18).when(tight(r).contains(v), 12).when(tight(b).contains(v), 6).otherwise(0)
    for words, high, low in ((tokens, 3, 1), (focus, 4, 2), (keywords, 5, 2)):
        for w in words:
            total = total + F.when(t.contains(w), high).when(b.contains(w), low).otherwise(0)
    return total.cast("long")


def first_rule(text: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The name of the first pattern that a text matches."""
    out = None
    for name, pattern in rules:
        hit = text.rlike(f"(?i)(?:{pattern})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def dataset_language(text: Column) -> Column:
    """By counts of letters; fewer than three of one kind don't make a text mixed."""
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    hangul, latin = count("[가-힯ᄀ-ᇿ㄰-㆏]"), count("[A-Za-z]")
    return F.when((hangul == 0) & (latin == 0), "unknown").when(hangul == 0, "en").when(latin == 0, "ko").when(hangul < 3, "en").when(latin < 3, "ko").otherwise("mixed")


def migration_language(text: Column) -> Column:
    """ko from 30 % of Hangul and Han, mixed from one such letter, else en."""
    share = F.length(text) - F.length(F.regexp_replace(text, "[가-힣一-鿿]", ""))
    return F.when(F.length(text) == 0, "en").when(10 * share >= 3 * F.length(text), "ko").when(share > 0, "mixed").otherwise("en")


def preserved_terms(text: Column) -> Column:
    """Distinct Latin terms of two letters and more, in order."""
    return F.array_distinct(F.filter(T.all_matches(F.lower(text), r"[a-z][a-z0-9_+./-]*"), lambda t: F.length(t) >= 2))


def route_tags(text: Column) -> Column:
    language = T.query_language(text)
    return F.array_compact(F.array(F.concat(F.lit("language:"), language), F.when(language == "mixed", "korean_first_mixed"), F.when(F.size(preserved_terms(text)) > 0, "preserve_english_terms")))


def is_follow_up(text: Column, most: int = 25) -> Column:
    """A short prompt that begins with a word which leans on the turn before."""
    own = F.trim(text)
    return (F.length(own) > 0) & (F.length(own) < most) & own.rlike(FOLLOW_UP)


def answer_tokens(text: Column) -> Column:
    return F.array_distinct(T.all_matches(F.lower(text), "[0-9a-z가-힣_]+"))


def answer_signals(prompt: Column, question: Column, question_words: list[str]) -> tuple[Column, Column]:
    """How many of four signs say that a prompt answers a pending question (length, no question mark, no question word, a
    fifth of the question's tokens), and whether three do."""
    body = F.trim(prompt)
    asked = answer_tokens(question)
    overlap = F.size(F.array_intersect(answer_tokens(body), asked)) * 5 >= F.size(asked)
    signs = count_of([F.length(body) >= 20, ~body.rlike("[?？]$"), held(F.lower(body), question_words) == 0, (F.size(asked) > 0) & overlap])
    return signs, signs >= 3


def self_score(text: Column) -> Column:
    """The first number from 1 to 10 that stands alone."""
    return F.regexp_extract(text, r"(?<!\d)(10|[1-9])(?!\d)", 1).try_cast("long")


def level(total: Column) -> Column:
    return F.when(total >= 9, "L5").when(total >= 7, "L4").when(total >= 5, "L3").when(total >= 3, "L2").otherwise("L1")


def drill_dimensions(answer: Column, expected: Column) -> dict[str, Column]:
    """Accuracy (0 to 4), depth (3), practicality (2) and completeness (1) of an answer."""
    tokens, low = answer_tokens(answer), F.lower(answer)
    n, wanted = F.size(tokens), F.size(expected)
    found = F.size(F.filter(expected, lambda t: F.array_contains(tokens, F.lower(t))))
    loose = F.when(n >= 24, 4).when(n >= 16, 3).when(n >= 8, 2).when(n >= 3, 1).otherwise(0)
    strict = F.when(found * 5 >= wanted * 4, 4).when(found * 5 >= wanted * 3, 3).when(found * 5 >= wanted * 2, 2).when(found * 5 >= wanted, 1).otherwise(0)
    return {
        "accuracy": F.when(wanted == 0, loose).otherwise(strict).cast("long"),
        "depth": F.least(F.lit(3), held(answer, DEPTH_MARKERS)).cast("long"),
        "practicality": F.least(F.lit(2), held(answer, PRACTICAL_MARKERS)).cast("long"),
        "completeness": ((held(low, GIVING_UP) == 0) & (F.length(F.trim(answer)) >= 40)).cast("long"),
    }


def weak_tags(dimensions: dict[str, Column]) -> Column:
    """Dimensions under their threshold."""
    least = {"accuracy": 3, "depth": 2, "practicality": 1, "completeness": 1}
    return F.array_compact(F.array(*(F.when(c < least[n], n) for n, c in dimensions.items())))


def router_safe(phrase: Column) -> Column:
    """Whether a phrase says enough to route by: no stop word, two characters, and short ASCII only with a digit or in
    capitals."""
    short = phrase.rlike(r"^[\x00-\x7F]{1,2}$") & ~phrase.rlike("[0-9]")
    capitals = (F.upper(phrase) == phrase) & phrase.rlike("[A-Z]")
    return ~F.lower(phrase).isin(PHRASE_STOPLIST) & (F.length(phrase) >= 2) & (~short | capitals)


def repeats_itself(text: Column) -> Column:
    """A paragraph of 80 characters or a sentence of 120 that comes again, whatever its case and blanks."""
    flat = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    again = lambda parts, least: F.size(F.array_distinct(F.transform(F.filter(parts, lambda x: F.length(F.trim(x)) >= least), flat))) < F.size(F.filter(parts, lambda x: F.length(F.trim(x)) >= least))
    sentences = F.split(F.regexp_replace(text, r"([.!?。])\s+", "$1\u0001"), "\u0001")
    return again(F.split(text, r"\n\s*\n"), 80) | again(sentences, 120)


def quality_flags(text: Column, expected: Column, declared: Column, longest: int = 6000, header: bool = False) -> Column:
    """Sorted flags of an answer and its citations."""
    none, known = F.size(declared) == 0, F.size(expected) > 0
    flags = [F.when(known & none, "missing_citation"), F.when(known & ~none & ~F.arrays_overlap(expected, declared), "citation_mismatch"), F.when(repeats_itself(text), "duplicate_text"), F.when(F.length(text) > longest, "overlong_answer")]
    if header:
        flags.append(F.when(~F.ltrim(text).startswith("[RAG:"), "missing_rag_header"))
    return F.sort_array(F.array_compact(F.array(*flags)))


def excerpt(text: Column, size: int) -> Column:
    clean = T.redact(F.coalesce(text, F.lit("")))
    return F.when(F.length(clean) <= size, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, size)), F.lit("...")))


def first_lines(text: Column, n: int) -> Column:
    """The first lines, with an ellipsis where there are more."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.when(F.size(lines) <= n, F.array_join(lines, "\n")).otherwise(F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n...")))


def quoted_scalar(value: Column) -> Column:
    """A front-matter scalar: quoted where it holds a colon, a hash or quotes, with quotes escaped."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(value.rlike(r"""[:#"']"""), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)
