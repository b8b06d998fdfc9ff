"""Questions: formats by statement and alternatives, outcomes, identifiers, labels, file descriptors and the choice of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.classify import first_match

# The rules of formats, in the order in which they hold. Patterns on folded text have ASCII letters only.
ROMAN = r"^(I|II|III|IV|V|VI)(\s*(,|e)\s*(I|II|III|IV|V|VI))*\s*(,\s*apenas)?\.?$"
TRUE_FALSE = r"^([VF]\s*[-–,]?\s*){3,}\.?$"
MATCHING = r"^(\d\s*[-–)]\s*[a-zA-Z]|[A-Z]{1,2}(\s*,\s*[A-Z]{1,2}){2,}\.?$|[IVX]+\s*[-–]\s*[a-z0-9])"
CODE_PHRASE = r"(trecho de codigo|codigo a seguir|codigo-fonte|pseudocodigo|programa a seguir|funcao a seguir|algoritmo a seguir|consulta sql|em linguagem c\b|em python\b|em java\b)"
CODE_SYNTAX = r"\bprintf\b|\bscanf\b|\bdef \w+\(|\bint \w+\s*[=;(]|\bwhile\s*\(|\bfor\s*\(|\breturn\b|\bpublic (class|void)|\bvoid \w+\s*\(|\bselect\b[\s\S]{1,80}\bfrom\b|\bfimpara\b|\bfimse\b|\+\+|==|!="
CODE_ALTERNATIVE = r"\bselect\b[\s\S]*\bfrom\b|[{}]|\breturn\b|\w\(\s*\)"
NUMERIC = r"^[\s\dR$.,%+\-−×x*/=()ΩµμmkMGHzVAWsbBpPº°]+\.?$"
INTERPRETED = r"\b(texto|grafico|figura|imagem|tirinha|charge|infografico|tabela)\b|disponivel em"
OUTCOMES = [
    ("sao(proposicoes)?verdadeiraseaiieumajustificativa", "both-true-justifies"),
    ("sao(proposicoes)?verdadeirasmasaiinao", "both-true-no-justification"),
    ("aassercaoieumaproposicaoverdadeiraeaiieumaproposicaofalsa", "only-i-true"),
    ("aassercaoieumaproposicaofalsaeaiieumaproposicaoverdadeira", "only-ii-true"),
    ("sao(proposicoes)?falsas", "both-false"),
]
COURSES = [
    (r"ciencias?_(da_)?computacao|cie_com(_|$)|^(\d+_)?(gab_)?computacao_bacharel", "ciencia_da_computacao"),
    (r"engenharia_(da_|de_)?computacao|eng_com(_|$)", "engenharia_da_computacao"),
    (r"sistemas?_(de_)?informacao|sis_informacao", "sistemas_de_informacao"),
    (r"engenharia_(de_)?software|eng_sof(_|$)", "engenharia_de_software"),
    (r"analise_(e_)?desenv(olvimento)?_(de_)?sistemas|ana_des_sis|desenvolvimento_(de_)?sistemas", "analise_e_desenvolvimento_de_sistemas"),
]
VARIANT = r"ledor|ampliada|super|braille|nvda|libras|video|_ac_|transcri"
TEACHING = r"licenciatura|(^|_)lic(_|$)"
FILE_TYPES = [(r"(^|_)discursiva(_|$)", "answerGuide"), (r"(^|_)pv(_|$)", "exam"), (r"(^|_)gb(_|$)", "answerKey"), (r"(^|_)mp(_|$)", "testMap")]
FOLDERS = [("/provas/", "exam"), ("/gabaritos/", "answerKey"), ("/padrao_resposta/", "answerGuide")]
NAME_PARTS = "pv|gb|gab|mp|discursiva|cst|baixa|alta|bacharel|bacharelado"


def detect_format(statement: Column, alternatives: Column) -> Column:
    """The first rule that holds for a statement and its alternatives (an array of texts)."""
    alts = F.transform(alternatives, lambda a: F.regexp_replace(a, rf"^{T.BLANK}+|{T.BLANK}+$", ""))

    def rules(both: Column) -> Column:
        f, alts = both["f"], both["alts"]
        plain = F.transform(alts, T.fold)

        def most(holds) -> Column:
            return (F.size(alts) > 0) & (F.size(F.filter(alts, holds)) >= F.size(alts) - 1)

        assertion = F.exists(plain, lambda a: F.contains(a, F.lit("as assercoes i e ii"))) | (statement.rlike(r"(?<![A-Za-z0-9_])PORQUE(?![A-Za-z0-9_])") & F.contains(f, F.lit("assercoes")))
        syntax = F.size(F.array_distinct(F.regexp_extract_all(f, F.lit(CODE_SYNTAX), F.lit(0))))
        code = f.rlike(CODE_PHRASE) | (syntax >= 2) | (F.size(F.filter(plain, lambda a: a.rlike(CODE_ALTERNATIVE))) >= 2)
        return (
            F.when(assertion, "assertion-reason")
            .when(most(lambda a: F.regexp_replace(a, r"\s+", " ").rlike(ROMAN)), "statements")
            .when(most(lambda a: a.rlike(TRUE_FALSE)), "true-false")
            .when(most(lambda a: a.rlike(MATCHING)), "matching")
            .when(code, "code")
            .when(most(lambda a: a.rlike(NUMERIC) & a.rlike(r"\d")), "calculation")
            .when(f.rlike(INTERPRETED), "interpretation")
            .otherwise("conceptual")
        )

    return T.let(F.struct(T.fold(statement).alias("f"), alts.alias("alts")), rules)


def statement_count(answer_text: Column, corrected: bool = False) -> Column:
    """How many statements an answer such as `I, II e III` names; null for an empty one.

    Commas go before the text is split at them, so that only `e` counts; ``corrected`` keeps them.
    """
    gone = r"\.|apenas" if corrected else r"[.,]|apenas"
    bare = T.squeeze(F.regexp_replace(answer_text, gone, ""))
    n = F.size(F.filter(F.split(bare, r"\s*(?:,|e)\s*"), lambda x: x != ""))
    return F.when(bare != "", n)


def outcome(answer_text: Column) -> Column:
    """The canonical outcome that an assertion's answer words, compared without blanks and commas."""
    return first_match(F.regexp_replace(T.fold(answer_text), r"[\s,]", ""), OUTCOMES, "other")


def split_question(lines: Column) -> Column:
    """A struct of statement and alternatives from a question's lines.

    The alternatives begin at the last line A from which, taking the first B behind it, the first C behind that and so on, four letters
    at least are found. One pass from the last line to the first keeps the run that starts at each letter.
    """
    runs = "struct<A:array<int>,B:array<int>,C:array<int>,D:array<int>,E:array<int>>"
    none = F.array().cast("array<int>")
    letters = F.reverse(F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, r"^([A-E])(?:\s|$)", 1).alias("l"), i.alias("i"))))

    def step(s: Column, x: Column) -> Column:
        at = lambda k, rest: F.when(x["l"] == k, F.concat(F.array(x["i"]), rest)).otherwise(s[k])
        whole = (x["l"] == "A") & (F.size(s["A"]) == 0) & (F.size(s["B"]) >= 3)
        first = F.when(whole, F.concat(F.array(x["i"]), s["B"])).otherwise(s["A"])
        return F.struct(first.alias("A"), at("B", s["C"]).alias("B"), at("C", s["D"]).alias("C"), at("D", s["E"]).alias("D"), at("E", none).alias("E")).cast(runs)

    best = F.aggregate(letters, F.struct(*[none.alias(k) for k in "ABCDE"]).cast(runs), step, lambda s: s["A"])

    def parts(best: Column) -> Column:
        def alternative(at: Column, n: Column) -> Column:
            end = F.coalesce(F.get(best, n + 1), F.size(lines))
            first = F.regexp_replace(F.get(lines, at), r"^[A-E]\s*", "")
            return T.squeeze(F.concat_ws(" ", first, F.array_join(F.slice(lines, at + 2, end - at - 1), " ")))

        before = F.when(F.size(best) > 0, F.slice(lines, F.lit(1), F.get(best, F.lit(0)))).otherwise(lines)
        return F.struct(F.array_join(before, "\n").alias("statement"), F.transform(best, alternative).alias("alternatives"))

    return T.let(best, parts)


def title(slug: Column, known: dict[str, str]) -> Column:
    """The known name of a slug, else its words with capitals."""
    out = F.initcap(F.replace(slug, F.lit("_"), F.lit(" ")))
    for name, label in known.items():
        out = F.when(slug == name, label).otherwise(out)
    return out


def identifier(exam: Column, kind: Column, nums: Column) -> Column:
    """exam-qNN, exam-dN or exam-tNN-NN for objective, essay and shared blocks."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    first = F.get(nums, F.lit(0))
    tail = F.when(kind == "objective", F.concat(F.lit("q"), two(first))).when(kind == "essay", F.concat(F.lit("d"), first.cast("string")))
    return F.concat_ws("-", exam, tail.otherwise(F.concat(F.lit("t"), F.array_join(F.transform(nums, two), "-"))))


def describe_files(files: DataFrame) -> DataFrame:
    """file, type, booklet, range_from, range_to, course, computing and modality of the files (url, year, seq) that belong to their year,
    without accessibility variants and files of unknown type."""
    last = F.element_at(F.split("url", "/"), -1)
    rows = files.withColumn("file", T.let(last, lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)))
    rows = rows.withColumn("name", F.lower(F.regexp_replace("file", r"(?i)\.pdf$", "")))
    year, low, folder = F.col("year").cast("string"), F.lower("url"), F.lit(None).cast("string")
    for part, kind in FOLDERS:
        folder = F.when(F.contains(low, F.concat(F.lit(part), year, F.lit("/"))), kind).otherwise(folder)
    rows = rows.withColumn("folder", folder).where((F.col("folder").isNotNull() | F.startswith("name", year)) & ~F.col("name").rlike(VARIANT))
    guide = F.when(F.contains(low, F.lit("padrao_resposta")), "answerGuide")
    rows = rows.withColumn("type", F.coalesce("folder", guide, first_match(F.col("name"), FILE_TYPES))).where("type IS NOT NULL")
    bound = lambda k: F.regexp_extract("name", r"_(?:pv|gb)_(\d+)_a_(\d+)", k).try_cast("int")
    single = F.regexp_extract("name", r"_(?:pv|gb)_(\d+)(?:_|$)", 1).try_cast("int")
    slug = F.when(F.startswith("name", F.concat(year, F.lit("_"))), F.substring("name", F.length(year) + 2, F.length("name"))).otherwise(F.col("name"))
    for pattern, to in ((r"(^|_)(padrao_resposta|pad_resp)(?=_|$)", ""), (rf"(^|_)({NAME_PARTS})(?=_|$)", ""), (r"_\d+_a_\d+$", ""), (r"(^|_)\d+(?=_|$)", ""), (r"^_+|_+$", ""), (r"_+", "_")):
        slug = F.regexp_replace(slug, pattern, to)
    known = first_match(F.col("name"), COURSES)
    booklet = F.when(bound(1).isNull(), F.coalesce(single, F.lit(1)))
    return rows.select("seq", "year", "file", "type", booklet.alias("booklet"), bound(1).alias("range_from"), bound(2).alias("range_to"), F.coalesce(known, slug).alias("course"), known.isNotNull().alias("computing"), F.when(F.col("name").rlike(TEACHING), "teaching").otherwise("bachelor").alias("modality"))


TYPES = ["exam", "answerKey", "answerGuide", "testMap"]


def select_exams(described: DataFrame) -> DataFrame:
    """For each year and bachelor course the best file of each type: booklet 1, else a range from 1, else the first."""
    rank = F.struct(F.when(F.col("booklet") == 1, 0).when(F.col("range_from") == 1, 1).otherwise(2), "seq")
    best = [F.min_by(F.when(F.col("type") == t, F.col("file")), F.when(F.col("type") == t, rank)).alias(t) for t in TYPES]
    return described.where("modality = 'bachelor'").groupBy("year", "course").agg(F.bool_or("computing").alias("computing"), *best)


def chosen_exams(selected: DataFrame) -> DataFrame:
    """The computing exams that have both a booklet and an answer key, by year and course."""
    return selected.where(F.col("computing") & F.col("exam").isNotNull() & F.col("answerKey").isNotNull()).orderBy("year", "course")


#: Short labels of courses.
SHORT = {"ciencia_da_computacao": "CC", "engenharia_da_computacao": "EC", "sistemas_de_informacao": "SI", "analise_e_desenvolvimento_de_sistemas": "ADS", "engenharia_de_software": "ES"}


def labels(rows: DataFrame, titles: dict[str, str], formats: DataFrame) -> DataFrame:
    """id with the labels of questions (id, kind, num, section, year, course, format): of the question, section, exam and format.

    A course without a short label shows its title; a format without a label is an essay.
    """
    full = title(F.col("course"), titles)
    short = F.coalesce(*[F.when(F.col("course") == k, v) for k, v in SHORT.items()], full)
    question = F.when(F.col("kind") == "essay", F.concat(F.lit("Discursiva "), F.col("num").cast("string"))).otherwise(F.concat(F.lit("Questão "), F.lpad(F.col("num").cast("string"), 2, "0")))
    section = F.when(F.col("section") == "general", "Formação Geral").otherwise("Componente Específico")
    exam = F.concat(full, F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    met = rows.join(formats.select("format", F.col("label").alias("of_format")), "format", "left")
    return met.select("id", question.alias("question_label"), section.alias("section_label"), exam.alias("exam_label"), short.alias("short_label"), F.coalesce("of_format", F.lit("Discursiva")).alias("format_label"))
