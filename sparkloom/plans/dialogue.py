"""Queries over prompts and answers, with their SQL. Prompts are user turns behind a phrase that hits a rule: the
tables have neither Hangul nor the vocabulary of the rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import dialogue as D
from sparkloom.functions import text as T
from sparkloom.operators import aliases as A
from sparkloom.functions.text import RETRIEVAL_TOKEN as TERM
from sparkloom.plans.base import query, read

PHRASES = ["사이클 2 리뷰 어떻게 수정", "step3 Repository transaction 테스트", "Cycle 4 dao와 dto 차이", "2단계 컨트롤러 설계 왜 안 돼", "what is a Bean", "왜 트랜잭션이 필요해", "DI가 뭐야", "gradle build 실패", "그건 왜 그래", "내 점수는 8점", "10/10 정도", "coach my PR 리뷰 봐줘", "rag로 깊게 transaction vs index", "그냥 답해 bean", "spring 공부 순서", "이유는 원리 때문이고 because 내부적으로 rollback 운영 장애", "잘 모르겠어 패스", "then why", "도메인 객체 모델링 entity modeling", "리뷰어 관점에서 비교 compare", "XA 2PC vs lock", "심화 deep dive internal", "12 34", "how does rollback behave in production"]


def listed(items) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


P = f"p AS (SELECT conv_id, turn, {listed(PHRASES)}[(conv_id * 5 + turn * 7) % {len(PHRASES)} + 1] || ' ' || substr(coalesce(text, ''), 1, 40) AS prompt, coalesce(text, '') AS body FROM conversations WHERE role = 'user')"


def prompts(spark, sf):
    k = ((F.col("conv_id") * 5 + F.col("turn") * 7) % len(PHRASES) + 1).cast("int")
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat(F.element_at(F.array(*map(F.lit, PHRASES)), k), F.lit(" "), F.substring(text, 1, 40)).alias("prompt"), text.alias("body"))


WORDS = "trim(regexp_replace(lower({x}), '[^0-9a-z가-힣]+', ' ', 'g'))"
MISSION = {"hint": "사이클2", "stages": ["2", "3"], "tokens": ["roomescape", "tracker"], "focus": ["transaction", "dao"], "keywords": ["controller design", "transaction", "bean"]}
VARIANTS = ["사이클2", "cycle2", "step2", "2단계", "사이클3", "cycle3", "step3", "3단계"]


def _score_sql() -> str:
    tight = lambda c: f"replace({c}, ' ', '')"
    parts = [f"CASE WHEN contains({tight('t')}, '사이클2') THEN 20 WHEN contains({tight('b')}, '사이클2') THEN 8 ELSE 0 END"]
    parts += [f"CASE WHEN contains({tight('t')}, '{v}') THEN 18 WHEN contains({tight('r')}, '{v}') THEN 12 WHEN contains({tight('b')}, '{v}') THEN 6 ELSE 0 END" for v in VARIANTS]
    for words, high, low in (("tokens", 3, 1), ("focus", 4, 2), ("keywords", 5, 2)):
        parts += [f"CASE WHEN contains(t, '{w}') THEN {high} WHEN contains(b, '{w}') THEN {low} ELSE 0 END" for w in MISSION[words]]
    return " + ".join(parts)


REFS = "'main step' || cast(conv_id % 6 AS VARCHAR)"
RELEVANT = f"""{P}, n AS (SELECT conv_id * 1000 + turn AS number, (conv_id * 37) % 101 AS updated, {WORDS.format(x='prompt')} AS t, {WORDS.format(x='body')} AS b, {WORDS.format(x=REFS)} AS r FROM p),
s AS (SELECT number, updated, cast({_score_sql()} AS BIGINT) AS score FROM n)"""


def relevant(spark, sf):
    refs = F.concat(F.lit("main step"), (F.col("conv_id") % 6).cast("string"))
    return prompts(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("number"), ((F.col("conv_id") * 37) % 101).alias("updated"), D.relevance(F.col("prompt"), F.col("body"), refs, **MISSION).alias("score"))


@query(f"WITH {RELEVANT} SELECT number, score FROM s")
def mission_relevance(spark, sf):
    return relevant(spark, sf).select("number", "score")


@query(f"WITH {RELEVANT}, m AS (SELECT * FROM s WHERE score >= 10 ORDER BY updated DESC, number DESC LIMIT 40) SELECT number, score, row_number() OVER (ORDER BY number) AS position FROM m")
def mission_selection(spark, sf):
    """A named stage asks for 10 points; the latest 40 are then put in the order of their numbers."""
    top = relevant(spark, sf).filter("score >= 10").orderBy(F.desc("updated"), F.desc("number")).limit(40)
    return top.select("number", "score", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("number")).cast("long").alias("position"))


NUMBERS = "list_sort(list_distinct(flatten([regexp_extract_all(lower(prompt), '사이클\\s*(\\d+)', 1), regexp_extract_all(lower(prompt), 'cycle\\s*(\\d+)', 1), regexp_extract_all(lower(prompt), 'step\\s*(\\d+)', 1), regexp_extract_all(lower(prompt), '(\\d+)\\s*단계', 1)])))"


@query(f"""WITH {P}, n AS (SELECT conv_id, turn, {NUMBERS} AS ns FROM p) SELECT conv_id, turn, array_to_string(ns, ',') AS stages,
array_to_string(list_sort(list_distinct(flatten(list_transform(ns, lambda n: ['사이클' || n, 'cycle' || n, 'step' || n, n || '단계'])))), ',') AS variants FROM n WHERE len(ns) > 0""")
def stage_spellings(spark, sf):
    n = prompts(spark, sf).withColumn("ns", D.stage_numbers(F.col("prompt"))).filter(F.size("ns") > 0)
    return n.select("conv_id", "turn", F.array_join("ns", ",").alias("stages"), F.array_join(D.stage_variants(F.col("ns")), ",").alias("variants"))


CONCEPTS = {"arch/repository": ["repository", "저장소"], "db/transaction": ["transaction", "트랜잭션", "rollback"], "spring/bean": ["bean", "빈 객체"], "spring/di": ["di", "의존성"], "test/unit": ["test", "테스트"]}


def mention_sql(col: str, word: str) -> str:
    if word.isascii():
        return f"regexp_matches({col}, '(?i)(^|[^A-Za-z0-9_]){word}([^A-Za-z0-9_]|$)')"
    return f"contains(lower({col}), '{word}')"


def count_sql(col: str, words) -> str:
    return "(" + " + ".join(f"cast({mention_sql(col, w)} AS BIGINT)" for w in words) + ")"


def held_sql(col: str, words) -> str:
    return "(" + " + ".join("cast(contains(" + col + ", '" + w.replace("'", "''") + "') AS BIGINT)" for w in words) + ")"


@query(f"WITH {P}, c AS (SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN {count_sql('prompt', ws)} > 0 THEN '{c}' END" for c, ws in CONCEPTS.items()) + "], lambda x: x IS NOT NULL) AS ids FROM p) SELECT conv_id, turn, array_to_string(ids, ',') AS concepts, array_to_string(ids[1:2], ' / ') AS first_two FROM c WHERE len(ids) > 0")
def concept_mentions(spark, sf):
    """Ids of the concepts whose aliases a prompt mentions."""
    ids = F.array_compact(F.array(*(F.when(D.mentioned(F.col("prompt"), ws) > 0, c) for c, ws in CONCEPTS.items())))
    out = prompts(spark, sf).withColumn("ids", ids).filter(F.size("ids") > 0)
    return out.select("conv_id", "turn", F.array_join("ids", ",").alias("concepts"), F.array_join(F.slice("ids", 1, 2), " / ").alias("first_two"))


ALIASES = "a AS (SELECT DISTINCT item_id AS concept, unnest(list_filter(regexp_extract_all(text, '[^\\x09-\\x0D .,]+'), lambda x: length(x) >= 4)) AS alias FROM benchmark)"


@query(rf"""WITH {ALIASES}, k AS (SELECT DISTINCT concept, lower(alias) AS alias, regexp_full_match(alias, '[\x00-\x7F]*') AS plain FROM a), u AS (SELECT DISTINCT alias, plain FROM k),
d AS (SELECT doc_id, lower(text) AS t, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS ws FROM documents),
f AS (SELECT doc_id, alias FROM (SELECT doc_id, unnest(ws) AS alias FROM d) w SEMI JOIN (SELECT alias FROM u WHERE plain) p USING (alias) UNION ALL SELECT doc_id, alias FROM d, u WHERE NOT plain AND contains(t, alias))
SELECT doc_id, concept, count(DISTINCT alias) AS n FROM f JOIN k USING (alias) GROUP BY 1, 2""")
def alias_concepts(spark, sf):
    """The words of every item are its aliases: which items each document mentions, and by how many of them."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x09-\x0D .,]+"), F.lit(0))
    aliases = read(spark, sf, "benchmark").select(F.col("item_id").alias("concept"), F.explode(F.filter(words, lambda x: F.length(x) >= 4)).alias("alias"))
    return A.by_concept(A.mentioned(read(spark, sf, "documents").select("doc_id", "text"), aliases), aliases, "doc_id")


SAFE = f"lower(phrase) NOT IN ({', '.join(repr(w) for w in D.PHRASE_STOPLIST)}) AND length(phrase) >= 2 AND (NOT (regexp_full_match(phrase, '[\\x00-\\x7F]{{1,2}}') AND NOT regexp_matches(phrase, '[0-9]')) OR (upper(phrase) = phrase AND regexp_matches(phrase, '[A-Z]')))"


@query(f"""WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS phrase FROM benchmark UNION SELECT unnest(['XA', 'xa', '2p', 'of', 'The', 'A', '빈', '객체'])) SELECT phrase, {SAFE} AS safe FROM w WHERE phrase <> ''""")
def router_safe_phrases(spark, sf):
    extra = spark.createDataFrame([(x,) for x in ("XA", "xa", "2p", "of", "The", "A", "빈", "객체")], "phrase string")
    words = read(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("phrase")).union(extra).distinct().filter("phrase <> ''")
    return words.select("phrase", D.router_safe(F.col("phrase")).alias("safe"))


TOKENS = "regexp_extract_all({x}, '[A-Za-z0-9]+|[가-힣]{{2,}}')"
SPACED = "' ' || trim(regexp_replace(lower({x}), '[^0-9a-z가-힣]+', ' ', 'g')) || ' '"


@query(f"""WITH b AS (SELECT DISTINCT {SPACED.format(x="array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+')[1:2], ' ')")} AS phrase, lower(list_filter({TOKENS.format(x='text')}[1:2], lambda t: length(t) >= 2)[1]) AS probe FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(list_transform({TOKENS.format(x='text')}, lambda t: lower(t)))) AS probe FROM documents), c AS (SELECT DISTINCT doc_id, phrase FROM b JOIN d USING (probe)), t AS (SELECT doc_id, {SPACED.format(x='text')} AS padded FROM documents)
SELECT phrase, count(*) AS n, min(doc_id) AS first_doc FROM c JOIN t USING (doc_id) WHERE contains(padded, phrase) GROUP BY 1""")
def phrase_probe_matches(spark, sf):
    """Phrases find candidates by their first token, then have to stand there whole."""
    spaced = lambda c: F.concat(F.lit(" "), D.compact_words(c), F.lit(" "))
    two = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)), 1, 2), " ")
    probe = F.get(F.filter(F.slice(T.phrase_probes(F.col("text")), 1, 2), lambda t: F.length(t) >= 2), F.lit(0))
    phrases = read(spark, sf, "benchmark").select(spaced(two).alias("phrase"), probe.alias("probe")).distinct()
    docs = read(spark, sf, "documents")
    own = docs.select("doc_id", F.explode(F.array_distinct(T.phrase_probes(F.col("text")))).alias("probe"))
    # texts only meet the phrases whose probe they have
    found = phrases.join(own, "probe").select("doc_id", "phrase").distinct()
    hits = found.join(docs.select("doc_id", spaced(F.col("text")).alias("padded")), "doc_id").filter(F.col("padded").contains(F.col("phrase")))
    return hits.groupBy("phrase").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"""WITH {P}, k AS (SELECT conv_id, turn, list_distinct(list_concat(list_distinct(list_filter(regexp_extract_all(lower(prompt), '{TERM}'), lambda t: length(t) >= 2)), list_filter(regexp_extract_all(lower(prompt), '[\\p{{L}}\\p{{N}}_@/.-]+'), lambda t: length(t) >= 2))) AS ts FROM p)
SELECT conv_id, turn, array_to_string(list_sort(list_filter(ts, lambda t: NOT list_contains({listed(D.GENERIC_SYMPTOMS)}, t))), ',') AS tokens FROM k""")
def symptom_terms(spark, sf):
    """Content tokens of a symptom, without generic ones."""
    ts = F.filter(T.symptom_tokens(F.col("prompt")), lambda t: ~t.isin(D.GENERIC_SYMPTOMS))
    return prompts(spark, sf).select("conv_id", "turn", F.array_join(F.sort_array(ts), ",").alias("tokens"))


LETTERS = "length({x}) - length(regexp_replace({x}, '{p}', '', 'g'))"


@query(f"""WITH {P}, c AS (SELECT conv_id, turn, prompt, {LETTERS.format(x='prompt', p='[가-힯ᄀ-ᇿ㄰-㆏]')} AS h, {LETTERS.format(x='prompt', p='[A-Za-z]')} AS l, {LETTERS.format(x='prompt', p='[가-힣一-鿿]')} AS k FROM p)
SELECT conv_id, turn, CASE WHEN h = 0 AND l = 0 THEN 'unknown' WHEN h = 0 THEN 'en' WHEN l = 0 THEN 'ko' WHEN h < 3 THEN 'en' WHEN l < 3 THEN 'ko' ELSE 'mixed' END AS dataset,
CASE WHEN length(prompt) = 0 THEN 'en' WHEN 10 * k >= 3 * length(prompt) THEN 'ko' WHEN k > 0 THEN 'mixed' ELSE 'en' END AS migration FROM c""")
def language_rules(spark, sf):
    """The two other rules for a text's language."""
    return prompts(spark, sf).select("conv_id", "turn", D.dataset_language(F.col("prompt")).alias("dataset"), D.migration_language(F.col("prompt")).alias("migration"))


@query(f"""WITH {P}, t AS (SELECT conv_id, turn, CASE WHEN regexp_matches(prompt, '[가-힣]') AND regexp_matches(prompt, '[A-Za-z]{{2,}}') THEN 'mixed' WHEN regexp_matches(prompt, '[가-힣]') THEN 'ko' WHEN regexp_matches(prompt, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language,
list_distinct(list_filter(regexp_extract_all(lower(prompt), '[a-z][a-z0-9_+./-]*'), lambda t: length(t) >= 2)) AS kept FROM p)
SELECT conv_id, turn, array_to_string(list_sort(kept), ',') AS preserved, 'language:' || language || CASE WHEN language = 'mixed' THEN ',korean_first_mixed' ELSE '' END || CASE WHEN len(kept) > 0 THEN ',preserve_english_terms' ELSE '' END AS tags FROM t""")
def query_plan_tags(spark, sf):
    return prompts(spark, sf).select("conv_id", "turn", F.array_join(F.sort_array(D.preserved_terms(F.col("prompt"))), ",").alias("preserved"), F.array_join(D.route_tags(F.col("prompt")), ",").alias("tags"))


def rules_sql(col: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '(?i)(?:{p})') THEN '{n}'" for n, p in rules) + " ELSE 'unknown' END"


@query(f"""WITH {P} SELECT conv_id, turn, {rules_sql('prompt', D.INTENT_PATTERNS)} AS intent, CASE WHEN conv_id % 5 = 0 THEN 'intermediate' ELSE {rules_sql('prompt', D.DIFFICULTY_HINTS)} END AS difficulty FROM p""")
def intent_and_difficulty(spark, sf):
    """The first pattern that matches names the intent; a level that is given goes before any hint."""
    level = F.when(F.col("conv_id") % 5 == 0, "intermediate").otherwise(D.first_rule(F.col("prompt"), D.DIFFICULTY_HINTS))
    return prompts(spark, sf).select("conv_id", "turn", D.first_rule(F.col("prompt"), D.INTENT_PATTERNS).alias("intent"), level.alias("difficulty"))


@query(f"""WITH {P}, s AS (SELECT conv_id, turn, trim(substr(prompt, 1, 12)) AS own FROM p), f AS (SELECT *, length(own) > 0 AND length(own) < 25 AND regexp_matches(own, '^\\s*(이거|이건|그거|그건|그럼|그러면|그래서|아까|방금|왜(\\s|$)|어떻게(\\s|$))|^\\s*(?i:this|that|then|so|why|how|what about|and then|example)\\b') AS follows,
lag(own) OVER (PARTITION BY conv_id ORDER BY turn) AS one, lag(own, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS two FROM s)
SELECT conv_id, turn, follows, CASE WHEN follows AND one IS NOT NULL THEN '이전 맥락: ' || concat_ws(', ', two, one) || chr(10) || '현재 질문: ' || own ELSE own END AS semantic FROM f""")
def follow_up_context(spark, sf):
    """Short prompts that lean on the turns before are asked together with the last two."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = prompts(spark, sf).select("conv_id", "turn", F.trim(F.substring("prompt", 1, 12)).alias("own"))
    rows = rows.withColumns({"one": F.lag("own").over(w), "two": F.lag("own", 2).over(w), "follows": D.is_follow_up(F.col("own"))})
    folded = F.concat(F.lit("이전 맥락: "), F.concat_ws(", ", "two", "one"), F.lit("\n현재 질문: "), "own")
    return rows.select("conv_id", "turn", "follows", F.when(F.col("follows") & F.col("one").isNotNull(), folded).otherwise(F.col("own")).alias("semantic"))


QUESTION_WORDS = ["what", "why", "how", "뭐야", "왜", "어떻게"]
ASKED = "list_distinct(regexp_extract_all(lower({x}), '[0-9a-z가-힣_]+'))"
ANSWERS = f"""{P}, q AS (SELECT conv_id, turn, trim(prompt) AS body, lag(body) OVER (PARTITION BY conv_id ORDER BY turn) AS pending FROM p),
a AS (SELECT conv_id, turn, body, cast(length(body) >= 20 AS BIGINT) + cast(NOT regexp_matches(body, '[?？]$') AS BIGINT) + cast({held_sql('lower(body)', QUESTION_WORDS)} = 0 AS BIGINT) + cast(len({ASKED.format(x='pending')}) > 0 AND 5 * len(list_intersect({ASKED.format(x='body')}, {ASKED.format(x='pending')})) >= len({ASKED.format(x='pending')}) AS BIGINT) AS signals FROM q WHERE pending IS NOT NULL)"""


def answers(spark, sf):
    """Prompts with what was asked before them, and how many signs say that they answer it."""
    pending = F.lag("body").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = prompts(spark, sf).withColumn("pending", pending).filter("pending is not null").withColumn("body", F.trim("prompt"))
    signals, is_answer = D.answer_signals(F.col("prompt"), F.col("pending"), QUESTION_WORDS)
    return rows.select("conv_id", "turn", "body", signals.alias("signals"), is_answer.alias("is_answer"))


@query(f"WITH {ANSWERS} SELECT conv_id, turn, signals, signals >= 3 AS is_answer FROM a")
def drill_answers(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", "signals", "is_answer")


MISSION_WORDS, CS_WORDS = ["리뷰", "pr", "step", "단계", "사이클"], ["transaction", "bean", "트랜잭션", "rollback", "entity"]


@query(f"""WITH {ANSWERS}, s AS (SELECT conv_id, turn, signals >= 3 AND conv_id % 3 = 0 AS answer, {held_sql('lower(body)', MISSION_WORDS)} AS m, {held_sql('lower(body)', CS_WORDS)} AS c, conv_id % 4 = 0 AS open, conv_id % 7 = 0 AND regexp_matches(body, '(^|[^0-9])(10|[1-9])([^0-9]|$)') AS score FROM a)
SELECT conv_id, turn, CASE WHEN answer AND m > 0 THEN 'mixed_with_drill_answer' WHEN answer THEN 'drill_answer' WHEN score THEN 'unknown' WHEN m = 0 AND c = 0 AND open THEN 'mission_only' WHEN m = 0 AND c = 0 THEN 'unknown' WHEN c = 0 THEN 'mission_only' WHEN m = 0 THEN 'cs_only' ELSE 'mixed' END AS intent,
CASE WHEN answer THEN 'cheap' WHEN score THEN 'skip' WHEN m = 0 AND c = 0 AND open THEN 'skip' WHEN m = 0 AND c = 0 THEN 'cheap' WHEN c = 0 THEN 'skip' ELSE 'full' END AS mode FROM s""")
def pre_intent(spark, sf):
    """What a turn is about before any search, and how much search it needs."""
    low = F.lower("body")
    rows = answers(spark, sf).select("conv_id", "turn", (F.col("is_answer") & (F.col("conv_id") % 3 == 0)).alias("answer"), D.held(low, MISSION_WORDS).alias("m"), D.held(low, CS_WORDS).alias("c"), (F.col("conv_id") % 4 == 0).alias("open"), ((F.col("conv_id") % 7 == 0) & D.self_score(F.col("body")).isNotNull()).alias("score"))
    m, c, silent = F.col("m") > 0, F.col("c") > 0, (F.col("m") == 0) & (F.col("c") == 0)
    intent = F.when(F.col("answer") & m, "mixed_with_drill_answer").when(F.col("answer"), "drill_answer").when(F.col("score"), "unknown").when(silent & F.col("open"), "mission_only").when(silent, "unknown").when(~c, "mission_only").when(~m, "cs_only").otherwise("mixed")
    mode = F.when(F.col("answer"), "cheap").when(F.col("score"), "skip").when(silent & F.col("open"), "skip").when(silent, "cheap").when(~c, "skip").otherwise("full")
    return rows.select("conv_id", "turn", intent.alias("intent"), mode.alias("mode"))


@query(f"""WITH {P} SELECT conv_id, turn, cast(regexp_extract(prompt, '(^|[^0-9])(10|[1-9])([^0-9]|$)', 2) AS BIGINT) AS score FROM p WHERE conv_id % 2 = 0 AND regexp_matches(prompt, '(^|[^0-9])(10|[1-9])([^0-9]|$)')""")
def self_assessments(spark, sf):
    """Scores of learners who were asked for one."""
    rows = prompts(spark, sf).filter("conv_id % 2 = 0").select("conv_id", "turn", D.self_score(F.col("prompt")).alias("score"))
    return rows.filter("score is not null")


# What topics and intents are known by.
TOPICS = [
    ("Repository", ["repository", "레포지토리", "저장소", "jdbcgamerepository", "boardrepository"], ["repository", "jdbc", "infra"]),
    ("DAO", ["dao", "gamedao", "piecedao"], ["dao", "data"]),
    ("Transaction", ["transaction", "rollback", "commit", "connectionfactory", "트랜잭션"], ["transaction", "connection", "database"]),
    ("Service", ["service", "application", "서비스"], ["service", "application", "usecase"]),
    ("Palace", ["palace", "궁성", "cannonpiece", "guardpiece", "generalpiece"], ["palace", "castle", "cannon", "guard", "general"]),
    ("Getter", ["getter", "getboard", "getname", "getteam"], ["getter"]),
    ("DTO", ["dto", "data", "entity"], ["dto", "data", "entity"]),
    ("Test", ["test", "테스트"], ["test"]),
    ("Domain", ["도메인", "모델", "모델링", "엔티티", "값객체", "객체", "도메인 설계", "도메인 객체", "도메인 모델", "엔티티 설계", "엔티티 모델링", "domain", "model", "entity", "aggregate", "entity modeling", "entity design", "domain modeling", "domain design", "domain object"], ["domain", "model", "entity", "aggregate"]),
    ("Controller", ["컨트롤러", "엔드포인트", "라우팅", "핸들러", "controller", "endpoint", "handler", "routing", "rest"], ["controller", "handler", "endpoint"]),
]
INTENTS = [
    ("review_triage", ["리뷰", "다음 액션", "먼저", "우선", "priority", "what next"], 1),
    ("concept_explanation", ["왜", "무슨 뜻", "설명", "개념", "차이", "difference"], 2),
    ("peer_comparison", ["다른 크루", "비교", "패턴", "어떻게 했", "compare"], 2),
    ("reviewer_lens", ["리뷰어", "관점", "reviewer"], 2),
    ("implementation_planning", ["수정", "반영", "리팩터링", "구조", "설계", "how to change"], 2),
    ("testing_strategy", ["테스트", "검증", "시나리오", "케이스", "test"], 3),
    ("pr_response", ["pr 본문", "리뷰 답변", "코멘트 답변", "답변", "reply", "response", "어떻게 답"], 4),
]
PATHS = ["src/main/java/infra/JdbcGameRepository.java", "src/test/java/DomainTest.java", "src/main/java/dao/piece-dao.java", "README.md", "src/main/java/web/view_controller.java"]
PIECES = "regexp_split_to_array(lower(path), '[/._ -]+')"
TOPIC_SQL = " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS topic, 3 * {held_sql('low', ws)} + " + " + ".join(f"CASE WHEN list_contains(pieces, '{w}') THEN 4 WHEN contains(lower(path), '{w}') THEN 2 ELSE 0 END" for w in ps) + (" + CASE WHEN lower(path) LIKE 'src/test/%' OR lower(path) LIKE '%test.java' THEN 5 ELSE 0 END" if n == "Test" else "") + " AS score FROM x" for n, ws, ps in TOPICS)


@query(f"""WITH {P}, y AS (SELECT conv_id, turn, lower(prompt) AS low, {listed(PATHS)}[conv_id % {len(PATHS)} + 1] AS path FROM p), x AS (SELECT *, {PIECES} AS pieces FROM y), s AS ({TOPIC_SQL}),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, topic) AS r FROM s WHERE score > 0)
SELECT p.conv_id, p.turn, coalesce(topic, 'Repository') AS topic, cast(coalesce(score, 0) AS BIGINT) AS score, CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM p LEFT JOIN b ON p.conv_id = b.conv_id AND p.turn = b.turn AND r = 1""")
def topic_scoring(spark, sf):
    """The topic with the most points from the prompt and the path of a changed file."""
    rows = prompts(spark, sf).select("conv_id", "turn", F.lower("prompt").alias("low"), F.element_at(F.array(*map(F.lit, PATHS)), (F.col("conv_id") % len(PATHS) + 1).cast("int")).alias("path"))
    pieces, path = F.split(F.lower("path"), "[/._ -]+"), F.lower("path")
    scores = []
    for name, words, parts in TOPICS:
        s = 3 * D.held(F.col("low"), words)
        for w in parts:
            s = s + F.when(F.array_contains(pieces, w), 4).when(path.contains(w), 2).otherwise(0)
        if name == "Test":
            s = s + F.when(path.startswith("src/test/") | path.endswith("test.java"), 5).otherwise(0)
        scores.append(F.struct((-s).alias("neg"), F.lit(name).alias("topic")))
    best = rows.select("conv_id", "turn", F.array_min(F.array(*scores)).alias("b"))
    some, score = F.col("b.neg") < 0, -F.col("b.neg")
    return best.select("conv_id", "turn", F.when(some, F.col("b.topic")).otherwise("Repository").alias("topic"), score.cast("long").alias("score"), F.when(score >= 6, "high").when(score >= 3, "medium").otherwise("low").alias("confidence"))


INTENT_SQL = " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS intent, {w} * {held_sql('lower(prompt)', ws)}" + (" + CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END" if n == "reviewer_lens" else "") + " AS score FROM p" for n, ws, w in INTENTS)


@query(f"""WITH {P}, s AS ({INTENT_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, intent) AS r FROM s WHERE score > 0)
SELECT p.conv_id, p.turn, coalesce(string_agg(intent, ',' ORDER BY r), 'review_triage') AS intents, cast(coalesce(max(score), 0) AS BIGINT) AS score FROM p LEFT JOIN b ON p.conv_id = b.conv_id AND p.turn = b.turn AND r <= 3 GROUP BY 1, 2""")
def intent_scoring(spark, sf):
    """The three intents with the most points; a named reviewer speaks for the reviewer's lens."""
    scores = []
    for name, words, weight in INTENTS:
        s = weight * D.held(F.lower("prompt"), words)
        if name == "reviewer_lens":
            s = s + F.when(F.col("conv_id") % 3 == 0, 2).otherwise(0)
        scores.append(F.struct((-s).alias("neg"), F.lit(name).alias("intent")))
    found = F.slice(F.sort_array(F.filter(F.array(*scores), lambda x: x["neg"] < 0)), 1, 3)
    rows = prompts(spark, sf).select("conv_id", "turn", found.alias("f"))
    names = F.array_join(F.transform("f", lambda x: x["intent"]), ",")
    return rows.select("conv_id", "turn", F.when(F.size("f") > 0, names).otherwise("review_triage").alias("intents"), F.coalesce(-F.get("f", F.lit(0))["neg"], F.lit(0)).cast("long").alias("score"))


#: Vocabularies of the router, by what they speak for; the operator takes any.
VOCABULARY = {"definition": ["뭐야", "what is", "개념"], "depth": ["왜", "차이", "vs", "how does"], "study": ["공부", "learn"], "domain": ["transaction", "트랜잭션", "bean", "rollback"], "learning": ["spring", "di"], "coach": ["리뷰 봐줘", "coach my pr"], "tool": ["gradle", "ide"], "skip": ["그냥 답해"], "force_coach": ["코치 모드"], "full": ["rag로 깊게"], "some": ["rag로"]}
MISSING = "conv_id % 5 = 0 OR conv_id % 2 = 1 OR conv_id % 3 <> 0"
ROUTED = f"""{P}, v AS (SELECT conv_id, turn, {", ".join(f"{count_sql('prompt', ws)} AS n_{k}" for k, ws in VOCABULARY.items())} FROM p), w AS (SELECT *, n_domain + n_learning AS n_known, {MISSING} AS missing FROM v),
t AS (SELECT *, n_skip + n_force_coach + n_full + n_some > 0 AS forced, CASE WHEN n_skip > 0 THEN 0 WHEN n_force_coach > 0 THEN 3 WHEN n_full > 0 THEN 2 WHEN n_some > 0 THEN CASE WHEN n_known > 0 AND n_depth > 0 THEN 2 ELSE 1 END WHEN n_coach > 0 THEN 3 WHEN n_tool > 0 AND n_known = 0 THEN 0 WHEN n_known > 0 AND n_depth > 0 THEN 2
WHEN n_known > 0 AND n_definition + n_study > 0 THEN CASE WHEN conv_id % 7 = 0 THEN 2 ELSE 1 END ELSE 0 END AS tier, n_skip + n_force_coach + n_full + n_some + n_coach = 0 AND NOT (n_tool > 0 AND n_known = 0) AND n_known > 0 AND n_depth = 0 AND n_definition + n_study > 0 AND conv_id % 7 = 0 AS promoted FROM w),
c AS (SELECT *, tier = 3 AND missing AS blocked FROM t),
f AS (SELECT *, CASE WHEN forced THEN 100 WHEN tier = 3 AND blocked THEN 60 WHEN tier = 3 THEN 95 WHEN tier = 2 AND promoted THEN 70 WHEN tier = 2 THEN CASE WHEN n_depth > 0 AND n_known > 0 THEN CASE WHEN n_definition > 0 OR n_study > 0 OR n_coach > 0 OR n_tool > 0 THEN 80 ELSE 85 END ELSE 55 END
WHEN tier = 1 AND n_definition > 0 AND n_known > 0 THEN 75 WHEN tier = 1 AND n_study > 0 AND n_known > 0 THEN 72 WHEN tier = 1 THEN 50 WHEN n_tool > 0 AND n_known + n_definition + n_depth + n_study = 0 THEN 85 WHEN n_known + n_definition + n_depth + n_study + n_coach = 0 THEN 60 ELSE 40 END AS confidence FROM c)"""


def routed(spark, sf):
    from sparkloom.operators import routing

    rows = prompts(spark, sf).withColumn("missing", (F.col("conv_id") % 5 == 0) | (F.col("conv_id") % 2 == 1) | (F.col("conv_id") % 3 != 0)).withColumn("repeated", F.col("conv_id") % 7 == 0)
    return routing.with_confidence(routing.routed(rows, "prompt", VOCABULARY, F.col("missing"), F.col("repeated")))


@query(f"WITH {ROUTED} SELECT conv_id, turn, cast(tier AS BIGINT) AS tier, CASE WHEN blocked THEN 'blocked' WHEN tier = 3 THEN 'coach-run' WHEN tier = 2 THEN 'full' WHEN tier = 1 THEN 'cheap' ELSE 'none' END AS mode, forced, promoted, cast(confidence AS BIGINT) AS confidence, confidence < 55 AS fallback FROM f")
def tier_router(spark, sf):
    """Overrides, then coaching, tools, depth and definitions decide how much search a prompt gets, and how sure that is."""
    return routed(spark, sf).select("conv_id", "turn", "tier", "mode", "forced", "promoted", "confidence", "fallback")


EXPECTED = "CASE WHEN conv_id % 2 = 0 THEN ['the', 'And', 'zebra', 'of', 'is'] ELSE [] END"
DIMS = f"""{P}, b AS (SELECT conv_id, turn, prompt, list_distinct(regexp_extract_all(lower(prompt), '[0-9a-z가-힣_]+')) AS ts, {EXPECTED} AS want FROM p),
d AS (SELECT conv_id, turn, CASE WHEN len(want) = 0 THEN CASE WHEN len(ts) >= 24 THEN 4 WHEN len(ts) >= 16 THEN 3 WHEN len(ts) >= 8 THEN 2 WHEN len(ts) >= 3 THEN 1 ELSE 0 END
ELSE CASE WHEN 5 * hits >= 4 * len(want) THEN 4 WHEN 5 * hits >= 3 * len(want) THEN 3 WHEN 5 * hits >= 2 * len(want) THEN 2 WHEN 5 * hits >= len(want) THEN 1 ELSE 0 END END AS accuracy, least(3, {held_sql('prompt', D.DEPTH_MARKERS)}) AS depth, least(2, {held_sql('prompt', D.PRACTICAL_MARKERS)}) AS practicality,
CASE WHEN {held_sql('lower(prompt)', D.GIVING_UP)} = 0 AND length(trim(prompt)) >= 40 THEN 1 ELSE 0 END AS completeness FROM (SELECT *, len(list_filter(want, lambda t: list_contains(ts, lower(t)))) AS hits FROM b) h)"""


@query(f"""WITH {DIMS}, t AS (SELECT *, accuracy + depth + practicality + completeness AS total FROM d)
SELECT conv_id, turn, cast(accuracy AS BIGINT) AS accuracy, cast(depth AS BIGINT) AS depth, cast(practicality AS BIGINT) AS practicality, cast(completeness AS BIGINT) AS completeness, cast(total AS BIGINT) AS total, CASE WHEN total >= 9 THEN 'L5' WHEN total >= 7 THEN 'L4' WHEN total >= 5 THEN 'L3' WHEN total >= 3 THEN 'L2' ELSE 'L1' END AS level,
concat_ws(',', CASE WHEN accuracy < 3 THEN 'accuracy' END, CASE WHEN depth < 2 THEN 'depth' END, CASE WHEN practicality < 1 THEN 'practicality' END, CASE WHEN completeness < 1 THEN 'completeness' END) AS weak FROM t""")
def drill_scoring(spark, sf):
    """Four dimensions of an answer, their total, its level and the weak ones."""
    expected = F.when(F.col("conv_id") % 2 == 0, F.array(*map(F.lit, ["the", "And", "zebra", "of", "is"]))).otherwise(F.array().cast("array<string>"))
    dims = D.drill_dimensions(F.col("prompt"), expected)
    rows = prompts(spark, sf).select("conv_id", "turn", *(c.alias(n) for n, c in dims.items()))
    total = sum((F.col(n) for n in dims), F.lit(0).cast("long"))
    return rows.select("conv_id", "turn", *dims, total.alias("total"), D.level(total).alias("level"), F.array_join(D.weak_tags({n: F.col(n) for n in dims}), ",").alias("weak"))


@query("""WITH x AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g'), '[0-9a-f]{32,}', '[token]', 'g'), '(?i)(password|passwd|pwd)\\s*[=:]\\s*[^\\s]+', '\\1=[secret]', 'g') AS clean, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations)
SELECT conv_id, turn, CASE WHEN length(clean) <= 50 THEN clean ELSE rtrim(substr(clean, 1, 50)) || '...' END AS excerpt, CASE WHEN len(ls) <= 2 THEN array_to_string(ls, chr(10)) ELSE array_to_string(ls[1:2], chr(10)) || chr(10) || '...' END AS head FROM x""")
def text_excerpts(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", D.excerpt(F.col("text"), 50).alias("excerpt"), D.first_lines(F.col("text"), 2).alias("head"))


PARTS = "list_filter({parts}, lambda x: length(trim(x)) >= {least})"
FLAT = "list_distinct(list_transform({x}, lambda x: lower(regexp_replace(trim(x), '\\s+', ' ', 'g'))))"
PARAGRAPHS, SENTENCES = PARTS.format(parts="regexp_split_to_array(text, '\\n\\s*\\n')", least=80), PARTS.format(parts="string_split(regexp_replace(text, '([.!?。])\\s+', '\\1' || chr(1), 'g'), chr(1))", least=120)
REPEATS = f"(len({FLAT.format(x=PARAGRAPHS)}) < len({PARAGRAPHS}) OR len({FLAT.format(x=SENTENCES)}) < len({SENTENCES}))"


AGAIN = "This passage of a document comes once more, in other letters and with other blanks, as a paragraph."


@query(f"WITH d AS (SELECT doc_id, text || CASE WHEN lang = 'de' THEN repeat(chr(10) || chr(10) || '{AGAIN}', 2) WHEN lang = 'fr' THEN chr(10) || chr(10) || '{AGAIN}' || chr(10) || chr(10) || upper('{AGAIN}') ELSE '' END AS text FROM documents) SELECT doc_id FROM d WHERE {REPEATS}")
def repeated_passages(spark, sf):
    """Documents with a paragraph or a long sentence that comes again; some get one."""
    planted = F.when(F.col("lang") == "de", f"\n\n{AGAIN}" * 2).when(F.col("lang") == "fr", f"\n\n{AGAIN}\n\n{AGAIN.upper()}").otherwise("")
    return read(spark, sf, "documents").withColumn("text", F.concat("text", planted)).filter(D.repeats_itself(F.col("text"))).select("doc_id")


CITED = f"""r AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN conv_id % 9 = 0 THEN chr(10) || chr(10) || repeat('long paragraph of an answer ', 4) || chr(10) || chr(10) || repeat('Long paragraph  of an answer ', 4) ELSE '' END || CASE WHEN conv_id % 13 = 0 THEN repeat('x', 7000) ELSE '' END AS text,
CASE WHEN conv_id % 4 = 0 THEN [] ELSE ['cs/' || cast(conv_id % 3 AS VARCHAR), 'db/1'] END AS expected, CASE conv_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['cs/1', 'net/2'] ELSE ['net/2', 'os/3', 'net/2'] END AS declared FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, turn, expected, declared, list_sort(list_filter([CASE WHEN len(expected) > 0 AND len(declared) = 0 THEN 'missing_citation' END, CASE WHEN len(expected) > 0 AND len(declared) > 0 AND NOT list_has_any(expected, declared) THEN 'citation_mismatch' END, CASE WHEN {REPEATS} THEN 'duplicate_text' END, CASE WHEN length(text) > 6000 THEN 'overlong_answer' END, CASE WHEN NOT starts_with(ltrim(text), '[RAG:') THEN 'missing_rag_header' END], lambda x: x IS NOT NULL)) AS flags FROM r)"""


def cited(spark, sf):
    c = F.col("conv_id")
    none = F.array().cast("array<string>")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(c % 9 == 0, "\n\n" + "long paragraph of an answer " * 4 + "\n\n" + "Long paragraph  of an answer " * 4).otherwise(""), F.when(c % 13 == 0, "x" * 7000).otherwise(""))
    expected = F.when(c % 4 == 0, none).otherwise(F.array(F.concat(F.lit("cs/"), (c % 3).cast("string")), F.lit("db/1")))
    declared = F.when(c % 3 == 0, none).when(c % 3 == 1, F.array(F.lit("cs/1"), F.lit("net/2"))).otherwise(F.array(F.lit("net/2"), F.lit("os/3"), F.lit("net/2")))
    rows = read(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", text.alias("text"), expected.alias("expected"), declared.alias("declared"))
    return rows.withColumn("flags", D.quality_flags(F.col("text"), F.col("expected"), F.col("declared"), header=True))


@query(f"WITH {CITED} SELECT conv_id, turn, array_to_string(flags, ',') AS flags FROM f")
def answer_quality_flags(spark, sf):
    return cited(spark, sf).select("conv_id", "turn", F.array_join("flags", ",").alias("flags"))


@query(f"WITH {CITED} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM f) t GROUP BY 1")
def quality_flag_frequency(spark, sf):
    return cited(spark, sf).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"WITH {CITED} SELECT array_to_string(expected, ', ') AS expected, array_to_string(declared, ', ') AS declared, count(*) AS n FROM f WHERE list_contains(flags, 'citation_mismatch') GROUP BY 1, 2")
def citation_mismatches(spark, sf):
    rows = cited(spark, sf).filter(F.array_contains("flags", "citation_mismatch"))
    return rows.groupBy(F.array_join("expected", ", ").alias("expected"), F.array_join("declared", ", ").alias("declared")).agg(F.count("*").alias("n"))


@query(f"WITH {CITED} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(declared, lambda x: NOT list_contains(expected, x)))), ',') AS ungrounded FROM f WHERE len(list_filter(declared, lambda x: NOT list_contains(expected, x))) > 0")
def ungrounded_citations(spark, sf):
    """Cited paths that no retrieval gave."""
    left = F.array_except("declared", "expected")
    return cited(spark, sf).filter(F.size(left) > 0).select("conv_id", "turn", F.array_join(F.sort_array(left), ",").alias("ungrounded"))
