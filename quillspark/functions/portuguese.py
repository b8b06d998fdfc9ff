"""Word lists for exams in Portuguese: the defaults of the statistics on words. Other collections pass their own."""

from __future__ import annotations

# Words without meaning for a topic, folded, and words of statements and citations.
STOP_WORDS = (
    "a o e de da do das dos em no na nos nas um uma uns umas para por com sem que se ao aos as os sua seu suas seus "
    "como mais ou sobre entre ja sao ser sendo foi pelo pela pelos pelas este esta esse essa isso isto nao sim "
    "cada tem ter mesmo quando onde qual quais seus muito pode podem forma meio partir ainda tambem apenas assim "
    "deve devem estao esta sera seria fim modo "
    "disponivel https http acesso adaptado avalie seguir seguinte considere considerando afirmar afirma afirmacoes "
    "correto correta texto textos questao questoes figura nessas nesses nessa nesse estar igual possua quantidade "
    "utilizando especialmente associado assegurar opcao alternativa apresentada apresentado apresenta informacoes "
    "formas diversos novos relacionados relacionadas etapas respeito outros outras sobre todos todas "
    "elementos sistema sistemas recursos revelam brasil brasileira brasileiro seguintes possivel situacao "
    "utilizado utilizada utilizar contexto acordo exemplo partir diante"
).split()

# Words that claim without exception, folded.
ABSOLUTE_WORDS = (
    "sempre nunca somente apenas exclusivamente unicamente todos todas nenhum nenhuma jamais necessariamente garante garantir impede elimina "
    "eliminar independentemente qualquer"
).split()

# Formats whose alternatives are sentences, so that their lengths and words can be compared.
FREE_TEXT_FORMATS = ["conceptual", "interpretation"]
