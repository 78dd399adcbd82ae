"""The citation grammar, statute and court tables, and constants, in Java's dialect.

These patterns and lists define the results, so they are stated as they are. Patterns run on the
matching view (see text.py), under the flags of `flagged`.
"""

from __future__ import annotations

STATES = "ac|al|ap|am|ba|ce|df|es|go|ma|mt|ms|mg|pa|pb|pr|pe|pi|rj|rn|rs|ro|rr|sc|sp|se|to"
NUMBER = r"[0-9](?:[0-9olsg.\s/\-]*[0-9olsg])?"
MARKER = r"(?:\s+n(?:[.o]\s*)?)?"
STATE_SUFFIX = rf"(?:\s*(?:/|-)\s*(?:{STATES})|\s*\(\s*(?:{STATES})\s*\))?"
BODY_DELIMITER = r"\n\s*\n\s*\n"
BODY_HEADING = r"(?m)^[ \t]*(?:relatorio|fundamentacao|ementa|voto|do\s+merito|merito)[ \t]*\r?$"
HEADER_CUES = [r"\bprocesso\b", r"\brelator\b", r"\btribunal\b", r"\bclasse\s+processual\b"]

CASE_CLASSES = [
    r"embargos\s+de\s+declaracao\s+no\s+agravo\s+interno\s+no\s+agravo\s+em\s+recurso\s+especial",
    r"embargos\s+de\s+declaracao\s+no\s+recurso\s+em\s+mandado\s+de\s+seguranca",
    r"agravo\s+interno\s+na\s+suspensao\s+de\s+liminar\s+e\s+de\s+sentenca",
    r"agravo\s+interno\s+no\s+agravo\s+em\s+recurso\s+especial",
    r"agravo\s+regimental\s+no\s+agravo\s+de\s+instrumento",
    r"edcl\s+nos\s+edcl\s+no\s+agint\s+no\s+agravo\s+em\s+recurso\s+especial",
    r"edcl\s+no\s+agint\s+no\s+(?:agravo\s+em\s+recurso\s+especial|recurso\s+especial|aresp|resp)",
    r"agint\s+nos\s+edcl\s+no\s+(?:recurso\s+especial|rec\.?\s*esp\.?|resp)",
    r"agint\s+no\s+(?:recurso\s+especial|agravo\s+em\s+recurso\s+especial|aresp|resp)",
    r"agint\s+na\s+(?:reclamacao|rcl)",
    r"agrg\s+no\s+(?:rec\.?\s*esp\.?|aresp|resp|h\.?c\.?)",
    r"eds?\s+no\s+agr-?respe",
    r"recurso\s+em\s+habeas\s+corpus",
    r"recurso\s+especial\s+eleitoral",
    r"agravo\s+em\s+recurso\s+especial",
    r"recurso\s+especial",
    r"terceiro\s+ag\.?reg\.?\s+na\s+rcl",
    r"agr-?respe",
    r"agr-?ai",
    r"hc",
    r"aresp(?:e[il])?",
    r"a\.?\s*resp",
    r"agre?sp",
    r"agint",
    r"ag\.?\s*int\.?",
    r"rec\.?\s*esp\.?",
    r"r\.?esp\.?",
    r"re[5s]p",
    r"respe\.?",
    r"reclamacao",
    r"recl\.?",
    r"rcl",
    r"rhc",
    r"rms",
    r"rse",
    r"apl",
    r"ar",
    r"re\.?",
]
CASE_CLASS = "(?:" + "|".join(CASE_CLASSES) + ")"
CASE = rf"(?<![a-z0-9])(?:(?:ed(?:cl|s)?|agrg?|agint)\s+nos?\s+)*{CASE_CLASS}{MARKER}\s+{NUMBER}{STATE_SUFFIX}(?![a-z0-9])"
TST_CASE = rf"(?<![a-z0-9])(?:processo\s+n(?:[.o]\s*)?\s*)?(?:tst\s*-\s*)?(?:(?:ed|e|ag|ai)\s*-\s*)*(?:agarr|airr|arr|rr)\s*-\s*{NUMBER}"
TSE_CASE = rf"(?<![a-z0-9])r\s*-\s*rp{MARKER}\s+{NUMBER}"
SUMMARY = r"(?<![a-z0-9])(?:su(?:m|rn)u[l1]a|5umula|sum\.)\s+(?:vinculante\s+)?(?:n(?:[.o]\s*)?\s*)?[0-9olsig]+(?:\s+do\s+(?:stf|stj|tst|tse))?"
TOPIC = rf"(?<![a-z0-9])tema\s+{NUMBER}\s+da\s+repercussao\s+geral"
LAW = (
    r"(?<![a-z0-9])art(?:igo|\.)?\s*[0-9]+(?:\.[0-9]{3})?o?"
    r"(?:\s*,\s*(?:§\s*[0-9]+o?(?:-[a-z])?|inciso\s+[ivxlcdm]+|[ivxlcdm]+|['\"]?[a-z]['\"]?))*"
    r"\s*,?\s*(?:do|da)\s+(?:"
    r"codig[0o]\s+(?:de\s+)?(?:processo\s+penal|processo\s+civil|defesa\s+do\s+consumidor|penal\s+militar|eleitoral|civil)"
    r"|consolidacao\s+das\s+leis\s+do\s+trabalho"
    r"|constituicao(?:\s+da\s+republica|\s+fed.ral)?"
    r"|lei\s+complementar\s+n(?:[.o]\s*)?\s*[0-9](?:[0-9./-]*[0-9])?"
    r"|lei\s+(?:n(?:[.o]\s*)?\s*)?[0-9](?:[0-9./-]*[0-9])?"
    r"|cpc|clt)"
)
VAGUE_HEAD = (
    r"(?<![a-z0-9])(?:orientacao\s+jurisprud[a-z]{3,9}"
    r"|ent[a-z]{4,10}ento\s+(?:sumulad[a-z]*|jurisprud[a-z]*|consolidad[a-z]*|reiterad[a-z]*)"
    r"|(?:verbete|enunciado)\s+sumular"
    r"|jurisprud[a-z]{3,9}"
    r"|(?:recent[a-z]*|reiterad[a-z]*)\s+(?:acordao|decisao|precedentes?)"
    r"|precedentes?|acordao|decisao|julgado"
    r"|normas?|legislacao|dispositivos?|artigo|lei)(?![a-z0-9])"
)
DESCRIBED_CASE = rf"(?<![a-z0-9]){CASE_CLASS}(?=\s+(?:do\s+(?:stf|stj|tst|tse|stm)\b|de\s+20[0-9]{{2}}\b))"
NAMED_DECISION = r"(?:recent[a-z]*\s+)?(?:precedente|acordao|decisao|julgado)\s+do\s+(?:stf|stj|tst|tse|stm)\b"
PHRASE_YEAR = r"\b(?:19|20)[0-9]{2}\b"
PHRASE_REPORTER = r"\b(?:relatoria\s+d[aeo]|rel\.?\s*(?:min\.?\s*)?)\s*[a-z]{2,}"

ABBREVIATIONS = "a ag art esp int min n no re rec recl rel rcl sum sumula".split()
BLANK_LINE = r"\n\s*\n"
CONTINUATION = r"\s+(?:para\s+sustentar|foi\s+reafirmad[a-z]*|afastou\s+(?:a\s+)?pretens[a-z]*|(?:antes|depois)\s+(?:d[oa]s?|de))\b"
SUBJECT = r"\b(?:tribunal|corte|stf|stj|tst|tse|stm)\b[^,.;\n]{0,50}?(\s+sobre\s+(?:a|o)\s+(?:materia|questao|tema|controversia))\b"
ENDING_COMMA = r",(?!\s*(?:de\s+20[0-9]{2}\b|(?:da|pela|sob)\s+relatoria\b|rel\.?\s*(?:min\.?\s*)?))"
PHRASE_LIMIT, DISTRACTOR_WINDOW, HEADER_LIMIT = 190, 80, 5000
DISTRACTOR = r"(?:\bcodigo|\barquivo(?:\s+interno)?(?:\s+denominado)?|\bprotocolo|\bsenha|\bprontuario)\s*[:#-]?\s*\z"
LAW_CUES = ["norma", "legislacao", "dispositivo", "artigo correspondente", "lei que"]

NUMBER_TOKEN = r"(?<!\w)\d(?:[\d\s./\-–—º°]*\d)?"
NUMBER_OPEN = r"(?U)\d[\d\s./\-–—º°]*\z"
NUMBER_BEFORE, NUMBER_AFTER, NUMBER_LIMIT, TST_NUMBER_LIMIT, NEAR_BEST = 140, 80, 400, 5000, 10
VARIANT_CHUNK = r"(?<!\w)\d[\d\s./\-olsg]*"
VARIANT_STATE = rf"(?i)(?:[/\-()]|\s)+(?:{STATES})\)?\s*\z"

#: Procedural families by context; the three of EXCLUSIVE_FAMILIES are tried in order and only the first that fits counts.
TST_FAMILY = r"(?:\btst\s*-|(?<![a-z])(?:airr|arr|rr)\s*-)"
EXCLUSIVE_FAMILIES = [
    ("respe", r"recurso\s+especial\s+eleitoral|respe|arespe[il]"),
    ("aresp", r"agravo\s+em\s+recurso\s+especial|aresp|a\.?\s*resp"),
    ("resp", r"recurso\s+especial|rec\.?\s*esp\.?|r\.?esp\.?|resp"),
]
FAMILIES = [
    ("rhc", r"recurso\s+em\s+habeas\s+corpus|\brhc\b"),
    ("rms", r"recurso\s+em\s+mandado\s+de\s+seguranca|\brms\b"),
    ("rcl", r"reclamacao|\brcl\b|\brecl\."),
    ("rse", r"recurso\s+em\s+sentido\s+estrito|\brse\b"),
    ("apl", r"apelacao|\bapl\b"),
    ("ai", r"agravo\s+(?:regimental\s+no\s+)?agravo\s+de\s+instrumento|agr-?ai"),
    ("agint", r"agravo\s+interno|\bagint\b|ag\.?\s*int\.?"),
    ("ar", r"acao\s+rescisoria|(?<![a-z])ar(?=\s|n?\.?\s*[0-9])"),
    ("sls", r"suspensao\s+de\s+liminar\s+e\s+de\s+sentenca"),
    ("rp", r"recurso\s+na\s+representacao|r\s*-\s*rp"),
    ("hc", r"habeas\s+corpus|(?<![a-z])h\.?c\.?(?=\s|n)"),
    ("re", r"recurso\s+extraordinario|(?<![a-z])re\.?(?=\s+n|\s+[0-9])"),
]

ARTICLE = r"\bart(?:igo|\.)?\s*([0-9]+(?:\.[0-9]{3})?)"
SUMMARY_NUMBER = r"\bsumula\s+(?:n(?:[.o]\s*)?\s*)?([0-9]+)"
SUMMARY_PARTS = r"(?:su(?:m|rn)u[l1]a|5umula|sum\.)\s+(vinculante\s+)?(?:n(?:[.o]\s*)?\s*)?([0-9olsig]+)"
COURT = r"\b(stf|stj|tst|tse)\b"

#: Statutes by what a citation or a declared source says; a value counts if just one fits.
STATUTES = [
    ("lei_complementar_64_1990", r"lei complementar(?: n[.o]?)? 64\s*/\s*(?:19)?90"),
    ("codigo_processo_civil_2015", r"(?:codig[0o] de processo civil|\bcpc\b|lei(?: n[.o]?)? 13\.?105\s*/\s*2015)"),
    ("codigo_penal_militar", r"codig[0o] penal militar|\bcpm\b|decreto-lei(?: n[.o]?)? 1\.?001\s*/\s*1969"),
    ("codigo_processo_penal", r"codig[0o] de processo penal|\bcpp\b|decreto-lei(?: n[.o]?)? 3\.?689\s*/\s*1941"),
    ("codigo_defesa_consumidor", r"codig[0o] de defesa do consumidor|\bcdc\b|lei(?: n[.o]?)? 8\.?078\s*/\s*1990"),
    ("codigo_eleitoral", r"codig[0o] eleitoral|lei(?: n[.o]?)? 4\.?737\s*/\s*1965"),
    ("codigo_civil", r"codig[0o] civil|\bcc\b|lei(?: n[.o]?)? 10\.?406\s*/\s*2002"),
    ("clt", r"consolidacao das leis do trabalho|\bclt\b|decreto-lei(?: n[.o]?)? 5\.?452\s*/\s*1943"),
    ("constituicao_federal", r"constituicao(?: da republica| fed.ral)?|\bcf(?:/88)?\b|\bcrfb(?:/88)?\b"),
]
#: Wording that tells the statute of a provision by its article, and the number of a court's summary.
PROVISION_WORDING = [
    ("276", "codigo_eleitoral", r"decisoes dos tribunais regionais sao terminativas"),
    ("290", "codigo_penal_militar", r"receber, preparar, produzir, vender, fornecer"),
    ("14", "codigo_defesa_consumidor", r"fornecedor de servicos responde"),
    ("93", "constituicao_federal", r"supremo tribunal federal.*estatuto da magistratura"),
    ("896", "clt", r"recurso de revista.*tribunal superior do trabalho"),
    ("7", "constituicao_federal", r"direitos dos trabalhadores urbanos e rurais"),
    ("5", "constituicao_federal", r"todos sao iguais perante a lei"),
    ("818", "clt", r"onus da prova incumbe.*reclamante"),
    ("312", "codigo_processo_penal", r"prisao preventiva.*garantia da ordem publica"),
    ("477", "clt", r"extincao do contrato de trabalho"),
    ("186", "codigo_civil", r"acao ou omissao voluntaria.*ato ilicito"),
    ("1", "lei_complementar_64_1990", r"sao inelegiveis"),
    ("373", "codigo_processo_civil_2015", r"onus da prova incumbe.*ao autor"),
]
SUMMARY_WORDING = [
    ("stf", "10", r"viola a clausula de reserva de plenario"),
    ("tst", "331", r"contrato de prestacao de servicos.*contratacao de trabalhadores por empresa interposta"),
]

#: Prose that stands before and after a citation in the development corpus; off by default.
TEMPLATE_BEFORE = [
    r"\brepousa\s+(?:n[oa]s?|em)\s+",
    r"\bInvoca-se,\s*ainda,\s*(?:[oa]s?)\s+",
    r"\bComo\s+(?:já\s+)?se\s+(?:reconheceu|depreend[ec]|deprcend[ec])\s+(?:n[oa]s?|d[oa]s?)\s+",
    r"\bRegistre-se,\s*por\s+oportuno,\s*(?:[oa]s?)\s+",
    r"\bImpõe-se\s+a\s+obs\w+nci[ao]\s+d[oa]s?\s+",
    r"\bNão\s+se\s+pode\s+ignorar\s+(?:[oa]s?)\s+",
    r"\bA\s+tese\s+encontra\s+respaldo\s+n[oa]s?\s+",
    r"\bVale\s+invocar\s+(?:[oa]s?)\s+",
    r"\bReforça\s+o\s+argumento\s+(?:[oa]s?)\s+",
    r"\bCumpre\s+lembrar\s+(?:[oaã]s?)\s+",
    r"\bAmpara[m]?\s+a\s+pretensão\s+(?:[oa]s?)\s+",
    r"\bNesse\s+exato\s+sentido\s+caminha[m]?\s+(?:[oa]s?)\s+",
    r"\bjulgamento\s+d[oa]s?\s+",
    r"\bViolou\s+o\s+acórdão\s+recorrido\s+(?:[oa]s?)\s+",
    r"\bCumpre\s+destacar\s+(?:[oa]s?)\s+",
    r"\bMerece\s+registro\s+(?:[oa]s?)\s+",
    r"\bAo\s+\w*preciar\s+(?:[oa]s?)\s+",
    r"\bIdêntica\s+conclusão\s+foi\s+adotada\s+n[oa]s?\s+",
    r"\bIncide,\s+na\s+espécie,\s+(?:[oa]s?)\s+",
    r"\bMilita\s+em\s+favor\s+d[ao]\s+parte\s+(?:[oa]s?)\s+",
    r"\bConfir\w*-se,\s+a\s+propósito,\s+(?:[oa]s?)\s+",
    r"\bA\s+orientação\s+firmada\s+n[oa]s?\s+",
    r"\bCorrobora\s+essa\s+leitura\s+(?:[oa]s?)\s+",
    r"\bEm\s+caso\s+análogo,\s+(?:[oa]s?)\s+",
    r"\bapoia-se\s+n[oa]s?\s+",
    r"\bRequer-se,\s+com\s+fund\w+\s+n[oa]s?\s+",
    r"\bNos\s+exatos\s+termos\s+d[oa]s?\s+",
    r"\bNão\s+destoa\s+dess\w+\s+ent\w+\s+(?:[oa]s?)\s+",
    r"\bA\s+hipótese\s+atrai\s+a\s+incidência\s+d[oa]s?\s+",
    r"\bdesconsiderou\s+por\s+completo\s+(?:[oa]s?)\s+",
    r"\bdecorre\s+diretamente\s+d[oa]s?\s+",
    r"\bTambém\s+n[oa]s?\s+",
    r"\bdiverge\s+frontalm\w*\s+d[oa]\s+qu\w+\s+[aã]ssentado\s+n[oa]s?\s+",
    r"\bAplica-se\s+à\s+espécie,\s*mutatis\s+mutandis,\s*o\s+quanto\s+decidido\s+n[oa]s?\s+",
    r"\bA\s+pretensão\s+encontra\s+amparo\s+expresso\s+n[oa]s?\s+",
    r"\bA\s+propósito,\s+veja-se\s+(?:[oa]s?)\s+",
    r"\bDeixou\s+o\s+Tribunal\s+de\s+origem\s+de\s+aplicar\s+(?:[oa]s?)\s+",
]
TEMPLATE_AFTER = [
    r",\s+no\s+ponto\b", r",\s+de\s+clareza\b", r",\s+cuja\s+ratio\b", r",\s+o\s+colegiado\b", r",\s+de\s+cujo\s+voto\b", r"\s+foi\s+rejeitad\w+\s+tese\b",
    r",\s+cuja\s+fundamentação\b", r",\s+no\s+qual\b", r",\s+precedente\b", r",\s+que\s+bem\b", r",\s+de\s+resto\b", r",\s+sob\s+pena\b", r",\s+que\s+trata\b",
    r",\s+de\s+aplicação\b", r",\s+(?:ao|à|aos|às)\s+qual\b", r",\s+a\s+distinção\b", r",\s+em\s+hipótese\b", r",\s+invocad\w*\b", r"\s+foi\s+reafirmada\b",
    r"\s+para\s+sustentar\b", r"\s+afastou\s+pretensão\b", r",\s+a\s+matéria\b", r",\s+embora\b", r",\s+a\s+reforma\b", r",\s+o\s+pedido\b", r",\s+que\s+reconhe\w+\s+a\s+excepcional\w+\b",
]
TEMPLATE_ABBREVIATIONS = ["a", "ag", "art", "esp", "int", "min", "n", "no", "nº", "n°", "re", "rec", "recl", "rel"]
TEMPLATE_LIMIT = 180

# The score's constants.
CLASSES = ["real", "inventada", "incompleta"]
LEVEL_WEIGHTS = {1: 1.0, 2: 2.0}
GRAVE_WEIGHT, BONUS_CAP, IOU_LEAST, CONTAINED_SHARE = 0.5, 0.10, 0.5, 0.9


def flagged(pattern: str) -> str:
    """Python's Unicode classes and case folding, and \\n alone as a line end, in Java."""
    return f"(?Uiud){pattern}"
