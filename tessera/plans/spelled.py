"""One spelling of every class of cases, template opening and ending, and many vague references.

Fixed values, each in the order of its pattern in functions.patterns.
"""

CASES = [
    "Embargos de Declaração no Agravo Interno no Agravo em Recurso Especial", "Embargos de Declaração no Recurso em Mandado de Segurança", "Agravo Interno na Suspensão de Liminar e de Sentença",
    "Agravo Interno no Agravo em Recurso Especial", "Agravo Regimental no Agravo de Instrumento", "EDcl nos EDcl no AgInt no Agravo em Recurso Especial", "EDcl no AgInt no Recurso Especial",
    "AgInt nos EDcl no Recurso Especial", "AgInt no AREsp", "AgInt na Reclamação", "AgRg no Rec. Esp.", "ED no AgR-REspe", "Recurso em Habeas Corpus", "Recurso Especial Eleitoral",
    "Agravo em Recurso Especial", "Recurso Especial", "Terceiro Ag.Reg. na Rcl", "AgR-REspe", "AgR-AI", "HC", "AREspEl", "A. Resp", "AgREsp", "AgInt", "Ag. Int.", "Rec. Esp.", "R.Esp.", "RE5p",
    "REspe.", "Reclamação", "Recl.", "Rcl", "RHC", "RMS", "RSE", "Apl", "AR", "RE.",
]
OPENINGS = [
    "A pretensão repousa no ", "Invoca-se, ainda, o ", "Como já se reconheceu no ", "Registre-se, por oportuno, o ", "Impõe-se a observância do ", "Não se pode ignorar o ", "A tese encontra respaldo no ",
    "Vale invocar o ", "Reforça o argumento o ", "Cumpre lembrar o ", "Ampara a pretensão o ", "Nesse exato sentido caminha o ", "No julgamento do ", "Violou o acórdão recorrido o ",
    "Cumpre destacar o ", "Merece registro o ", "Ao apreciar o ", "Idêntica conclusão foi adotada no ", "Incide, na espécie, o ", "Milita em favor da parte o ", "Confira-se, a propósito, o ",
    "A orientação firmada no ", "Corrobora essa leitura o ", "Em caso análogo, o ", "O pleito apoia-se no ", "Requer-se, com fundamento no ", "Nos exatos termos do ", "Não destoa desse entendimento o ",
    "A hipótese atrai a incidência do ", "O juízo desconsiderou por completo o ", "O direito decorre diretamente do ", "Também no ", "O julgado diverge frontalmente do quanto assentado no ",
    "Aplica-se à espécie, mutatis mutandis, o quanto decidido no ", "A pretensão encontra amparo expresso no ", "A propósito, veja-se o ", "Deixou o Tribunal de origem de aplicar o ",
]
ENDINGS = [
    ", no ponto", ", de clareza", ", cuja ratio", ", o colegiado", ", de cujo voto", " foi rejeitada tese", ", cuja fundamentação", ", no qual", ", precedente", ", que bem", ", de resto", ", sob pena",
    ", que trata", ", de aplicação", ", ao qual", ", a distinção", ", em hipótese", ", invocada", " foi reafirmada", " para sustentar", " afastou pretensão", ", a matéria", ", embora", ", a reforma", ", o pedido",
    ", que reconheceu a excepcionalidade",
]
#: What starts a vague reference, where it ends, and whether it is one: it must name a class or court, a year and a reporter.
VAGUE = [
    ("precedente do STJ de 2018, da relatoria de Ana Lima", ".", True), ("acórdão do STF de 2019, rel. Min. Rosa Reis", ".", True), ("decisão do TST de 2020, sob relatoria da Ministra Dora", ";", True),
    ("julgado do TSE de 2021, da relatoria do Ministro Rui", ", que decidiu", True), ("recente acórdão do STM de 2017, relatoria de Ivo", " para sustentar", True),
    ("Recurso Especial do STJ de 2016, da relatoria de Ana Lima", " foi reafirmado", True), ("Reclamação de 2015, rel. Min. Eva", " antes do julgamento", True), ("HC do STF de 2014, da relatoria de Rosa", "; e mais", True),
    ("precedente do STJ, da relatoria de Ana Lima", ".", False), ("precedente do STJ de 2018", ".", False), ("precedente da Terceira Turma de 2018, rel. Min. Ana", ".", False), ("jurisprudência dominante do STJ de 2018, rel. Min. Ana", ".", False),
]
