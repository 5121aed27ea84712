"""Facts in legal text, as columns over title and text. Patterns are (?iU): case and word classes by Unicode."""

from __future__ import annotations

import re
import re._parser as re_parser
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewatch.functions.text import all_matches, first_match

# The patterns of acts, rates, decisions, appeals, citations and amounts.
ACT = r"(?iU)(?:lei|decreto|portaria|resolu\w+|instru\w+|in)\s*(?:complementar\s*)?(?:n[ºo°.\s]+|n[uú]m\.?\s*|n[uú]mero\s*)?(\d{1,3}(?:\.\d{3})*|\d{1,5})[/.](\d{4})"
RATE = r"(?iU)\b(\d{1,2}(?:[.,]\d{1,2})?)\s*%\s*(?:de\s+(?:itcd|itcmd|itd|imposto)|sobre|para|incidente)"
RATE_RANGE = r"(?iU)\b(\d{1,2}(?:[.,]\d)?)\s*%\s*(?:a|até|-)\s*(\d{1,2}(?:[.,]\d)?)\s*%"
SANCTION = r"(?iU)\b(?:sanciona(?:da|do|r|ção)?|sancion(?:a|ou))\b"
VETO = r"(?iU)\b(?:vet(?:a|ou|ado|ada|o\b|ar)|veto\s+(?:parcial|total))\b"
RAPPORTEUR = (
    r"(?iU)relator[ai]?\s*[:\s][\s\.]*(?:dep\.?|sen\.?|min(?:istro)?\.?|des(?:embargador)?\.?|juiz|ju[ií]za|prof\.?)?\s*\.?\s*"
    r"([A-Z][a-zà-ú]+(?:\s+(?:da|de|do|das|dos|e)\s+[A-Z][a-zà-ú]+|\s+[A-Z][a-zà-ú]+){1,4})"
)
APPEALS = {
    "embargos": r"(?iU)\bembargos?\s+(?:infringentes?|de\s+divergência|declaração)\b",
    "resp": r"(?iU)\b(?:recurso\s+especial|REsp|R\.\s*Esp\.)\b(?:\s*nº?\s*\d{1,7})?",
    "re": r"(?iU)\b(?:recurso\s+extraordinário|^RE\s+\d|R\.\s*E\.)\b",
}
REPETITIVE = r"(?iU)\b(?:rito\s+dos?\s+|recurso(?:s)?\s+|matéria\s+)?repetitiv[ao]s?\b"
COURT_THEME = r"(?iU)\bTema\b[^\d\n]{0,40}?(\d{1,4})"
NORM = r"(?iU)\b(?:lei|decreto|portaria|resolu\w+|instru\w+|art(?:igo)?|s[uú]mula)\s*(?:complementar\s*)?(?:n[ºo°.]?\s*)?(\d{1,3}(?:\.\d{3})+[/.]\d{4}|\d{1,5}[/.]\d{4})"
AMOUNT = r"(?iU)R\$\s*\d{1,3}(?:\.\d{3})*(?:,\d{2})?(?:\s*(?:mil|milhão|milhões|bilhão|bilhões))?"
MODULATION = r"(?iU)modulação\s+(?:de\s+|dos\s+)?efeitos"
THEME_PATTERNS = {
    "planejamento_sucessorio": (r"planejamento\s+sucessório",),
    "holding_familiar": (r"holding\s+familiar", r"holding\s+patrimonial"),
    "doacao_com_usufruto": (r"doação\s+com\s+reserva\s+de\s+usufruto", r"reserva\s+de\s+usufruto", r"usufruto\s+vitalício"),
    "testamento": (r"\btestamento\b", r"\btestador(?:a)?\b", r"disposição\s+de\s+última\s+vontade"),
    "offshore_exterior": (r"\boffshore\b", r"bens\s+(?:no\s+)?(?:exterior|estrangeiros?)", r"sucessão\s+(?:internacional|transnacional)", r"trust\s+(?:familiar|sucessório)?"),
    "aliquota_progressiva": (r"alíquota\s+progressiva", r"progressividade\s+(?:da\s+)?alíquota", r"tabela\s+progressiva"),
    "pec_itcd_federal": (r"PEC\s+\d+\s*[/.]\s*\d+(?:[\s\S]{0,200}ITCD|ITCMD)", r"unificação\s+(?:nacional\s+)?do\s+ITCD", r"ITCD\s+federal", r"reforma\s+tributária[\s\S]{0,150}(?:ITCD|herança|sucessão)"),
    "fato_gerador": (r"fato\s+gerador\s+(?:do\s+)?(?:ITCD|ITCMD|imposto)", r"\bfato\s+gerador\b"),
    "base_de_calculo": (r"base\s+de\s+cálculo", r"valor\s+venal\s+(?:de\s+referência|do\s+bem|tributável)"),
    "isencao": (r"\bisenção\b", r"\bisento\b", r"\bisentar\b"),
    "imunidade": (r"\bimunidade\s+tributária\b", r"imunidade\s+(?:recíproca|de\s+templos|cultural)"),
    "gia_itcmd": (r"\bGIA[-\s]?ITCMD\b", r"\bGIA\b", r"declaração\s+(?:de\s+)?ITCMD", r"obrigação\s+acessória"),
}
THEMES = {name: "|".join(patterns) for name, patterns in THEME_PATTERNS.items()}
# Acts by type in order of priority, and issuing bodies in order.
ACT_TYPES = {
    "instrucao_normativa": r"\b(?:Instrução\s+Normativa|IN)\s*(?:RFB|SRF|SRFB|SECEX)?\s*(?:n[º°.]?\s*)?(\d{1,6}(?:\.\d{3})?)\s*[/\-]\s*(\d{4})\b",
    "provimento": r"\bProvimento\s*(?:n[º°.]?\s*)?(\d{1,5})\s*[/\-]?\s*(?:CNJ|CGJ|(\d{4}))",
    "decreto": r"\bDecreto\s*(?:n[º°.]?\s*)?(\d{1,6}(?:\.\d{3})?)\s*[/\-]\s*(\d{4})\b",
    "portaria": r"\bPortaria\s*(?:n[º°.]?\s*)?(\d{1,6}(?:\.\d{3})?)\s*[/\-]\s*(\d{4})\b",
    "lei": r"\bLei\s*(?:n[º°.]?\s*)?(\d{1,5}(?:\.\d{3})?)\s*[/\-]\s*(\d{4})\b",
}
BODIES = ("STF", "STJ", "RFB", "SRF", "PGFN", "AGU", "CNJ", "TIT-SP", "SEFAZ-SP", "SEFAZ-RJ", "SEFAZ-MG", "SEFAZ-RS", "SEFAZ-DF")
# Mentions of the civil code with what stands around, an article's number, and the articles that exist.
CODE_CONTEXT = r"(?iU)(?:Código\s+Civil|CC)\b.{0,200}|.{0,200}\b(?:Código\s+Civil|CC)\b"
CODE_MENTION = r"(?iU)(?:Código\s+Civil|CC)\b"
#: Ends of lines that no mention holds.
CODE_LINES = r"(?iU)[\n\r\u0085\u2028\u2029](?!\s*Civil)"
CODE_ARTICLE = r"(?iU)\b(?:art(?:igo|\.|s?\.)?\s*)?(\d{1,4}(?:\.\d{3})?)\b"
CODE_FIRST, CODE_LAST = 1, 2046


#: What acts and norms end with.
ACT_END = r"(?sU)^.*\d[/.]\d{4}"


def folded(c: Column) -> Column:
    """Lower case, for `may_match`: also letters that an expression without case takes for plain ones."""
    return F.lower(F.when(c.rlike("[İıſ\u212a]"), F.translate(c, "İıſ\u212a", "iisk")).otherwise(c))


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which every match of an expression has one; none if no such are known."""

    def best(part) -> frozenset[str]:
        run, found = "", []
        for op, value in [*part, (None, None)]:
            if op is re_parser.LITERAL:
                run += chr(value).lower()
                continue
            found, run = found + [frozenset([run])], ""
            if op is re_parser.SUBPATTERN:
                found.append(best(value[-1]))
            elif op in (re_parser.MAX_REPEAT, re_parser.MIN_REPEAT) and value[0] > 0:
                found.append(best(value[2]))
            elif op is re_parser.BRANCH:
                found.append(frozenset().union(*map(best, value[1])))
        return max(found, key=lambda x: min(map(len, x)))

    words = best(re_parser.parse(re.sub(r"^\(\?[isU]+\)", "", pattern)))
    return () if "" in words else tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))


#: For expressions whose strings are frequent, what each match holds, in text as `folded`.
HOLDS = {RATE: r"(?U)%\s*(?:de\s+i|sobre|para|incidente)", APPEALS["re"]: r"(?U)recurso\s+e|^re\s|r\.\s*e\."}


def may_match(low: Column, *patterns: str) -> Column:
    """Whether a text, as `folded`, has what the matches of some pattern need: cheap, and false for most texts."""

    def of(p: str) -> Column:
        has = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in needed(p)]) if needed(p) else F.lit(True)
        return has & low.rlike(HOLDS[p]) if p in HOLDS else has

    return reduce(lambda a, b: a | b, map(of, patterns))


def to_last_act(c: Column) -> Column:
    """The text up to the last digits that may end an act or a norm; empty without such."""
    return F.regexp_extract(c, ACT_END, 0)


def act(c: Column) -> Column:
    number, year = first_match(c, ACT), first_match(c, ACT, 2)
    return F.when(number.isNotNull(), F.concat_ws("/", F.replace(number, F.lit("."), F.lit("")), year))


def rates(c: Column) -> Column:
    comma = lambda a: F.transform(a, lambda x: F.replace(x, F.lit(","), F.lit(".")))
    ends = F.zip_with(all_matches(c, RATE_RANGE, 1), all_matches(c, RATE_RANGE, 2), lambda a, b: F.concat(a, F.lit("%-"), b, F.lit("%")))
    return F.concat(F.transform(comma(all_matches(c, RATE, 1)), lambda x: F.concat(x, F.lit("%"))), comma(ends))


def sanctioned(c: Column) -> Column:
    return c.rlike(SANCTION)


def vetoed(c: Column) -> Column:
    return c.rlike(VETO)


def rapporteur(c: Column) -> Column:
    return F.trim(first_match(c, RAPPORTEUR))


def norms(c: Column, most: int = 20) -> Column:
    return F.slice(F.array_distinct(all_matches(c, NORM, 1)), 1, most)


def revoked(c: Column) -> Column:
    """Norms within 200 characters after a form of `revogar`, in order, each once."""
    after = all_matches(c, r"(?isU)\brevog\w+(?=(.{0,200}))", 1)
    return F.array_distinct(F.flatten(F.transform(after, lambda x: all_matches(x, NORM, 1))))


def appeals(c: Column, low: Column | None = None) -> Column:
    low = folded(c) if low is None else low
    return F.array_sort(F.array_compact(F.array(*[F.when(may_match(low, p) & c.rlike(p), F.lit(n)) for n, p in APPEALS.items()])))


def repetitive(c: Column) -> Column:
    return c.rlike(REPETITIVE)


def court_themes(c: Column) -> Column:
    return all_matches(c, COURT_THEME, 1)


def amounts(c: Column, most: int = 10) -> Column:
    return F.slice(F.transform(all_matches(c, AMOUNT), lambda x: F.trim(x)), 1, most)


def modulated(c: Column) -> Column:
    return c.rlike(MODULATION)


def themes(c: Column, patterns: dict[str, str] = THEMES, low: Column | None = None) -> Column:
    low = folded(c) if low is None else low
    return F.array_sort(F.array_compact(F.array(*[F.when(may_match(low, p) & c.rlike("(?iU)" + p), F.lit(n)) for n, p in patterns.items()])))


def facts(c: Column, low: Column | None = None, acts: Column | None = None) -> Column:
    """All facts of a text as a map of strings; what isn't found isn't in it. Expressions run on texts only that have a string which
    they need. `low` and `acts` are the text as `folded` and `to_last_act`, for callers who hold them as columns."""
    low, acts = folded(c) if low is None else low, to_last_act(c) if acts is None else acts
    listed = lambda a, most: F.nullif(F.array_join(F.slice(a, 1, most), ","), F.lit(""))
    flag = lambda p: F.when(may_match(low, p) & c.rlike(p), F.lit("true"))
    some = lambda x, *patterns: F.when(may_match(low, *patterns), x)
    found = {
        "numero_ato": F.when(acts != "", act(acts)), "aliquotas": some(listed(rates(c), 5), RATE, RATE_RANGE), "relator": some(rapporteur(c), RAPPORTEUR), "revogacoes_citadas": some(listed(revoked(c), 5), "revog"), "recurso_tipos": listed(appeals(c, low), 3),
        "temas_stf_stj": some(listed(court_themes(c), 10), COURT_THEME), "normas_citadas": F.when(acts != "", listed(norms(acts), 10)), "valores_monetarios": some(listed(amounts(c), 5), AMOUNT), "temas_especificos": listed(themes(c, low=low), 12),
        "sancao_detectada": flag(SANCTION), "veto_detectado": flag(VETO), "repetitivo": flag(REPETITIVE), "modulacao_efeitos": flag(MODULATION),
    }
    return F.map_filter(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def with_facts(docs: DataFrame, form: Column, name: str = "facts") -> DataFrame:
    """`docs` with the facts of a text; its forms are columns first, so that each is made once."""
    d = docs.withColumn("__form", form)
    d = d.withColumns({"__low": folded(F.col("__form")), "__acts": to_last_act(F.col("__form"))})
    return d.withColumn(name, facts(F.col("__form"), F.col("__low"), F.col("__acts"))).drop("__form", "__low", "__acts")


def enrich(llm: Column, found: Column, most: int = 30) -> Column:
    """The classifier's metadata over the detected ones, at most `most` entries."""
    llm = F.coalesce(llm, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    both = F.map_concat(F.map_filter(found, lambda k, v: ~F.map_contains_key(llm, k)), llm)
    return F.map_from_entries(F.slice(F.map_entries(both), 1, most))


def act_type(c: Column) -> Column:
    """(tipo, numero, ano) of the first type in order that the text has."""

    def of(tipo: str, p: str) -> Column:
        number, year = F.replace(first_match(c, "(?iU)" + p), F.lit("."), F.lit("")), first_match(c, "(?iU)" + p, 2)
        return F.when(number.isNotNull(), F.struct(F.lit(tipo).alias("tipo"), F.concat_ws("/", number, year).alias("numero"), year.cast("int").alias("ano")))

    return F.coalesce(*[of(t, p) for t, p in ACT_TYPES.items()])


def body(c: Column, names=BODIES) -> Column:
    return F.coalesce(*[F.when(F.upper(c).rlike(rf"(?U)\b{n}\b"), F.lit(n)) for n in names])


def code_articles(c: Column) -> Column:
    """Numbers near a mention of the civil code, each once; below 100 only where `art` stands by. What is near a mention is in its
    line, or in the line where the mention ends, so only lines with one are searched."""

    def of(part: Column) -> Column:
        numbers = F.transform(all_matches(part, CODE_ARTICLE, 1), lambda n: F.replace(n, F.lit("."), F.lit("")).cast("int"))
        return F.filter(numbers, lambda n: (n >= 100) | F.lower(part).contains("art"))

    lines = F.filter(F.split(F.when(c.rlike(CODE_MENTION), c), CODE_LINES), lambda x: x.rlike(CODE_MENTION))
    near = F.flatten(F.transform(lines, lambda x: all_matches(x, CODE_CONTEXT, 0)))
    return F.coalesce(F.array_distinct(F.flatten(F.transform(near, of))), F.when(c.isNotNull(), F.array().cast("array<int>")))


def invalid_code_articles(c: Column) -> Column:
    """Numbers near a mention of the civil code that are no article of it."""
    return F.filter(code_articles(c), lambda n: ~n.between(CODE_FIRST, CODE_LAST))


def any_of(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])
