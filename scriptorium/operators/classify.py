"""Roles of sources and subjects of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.pyre import once, strip, text_lines
from scriptorium.functions.text import SPARSE

#: Extensions by kind of source, and names that a folder scan skips.
KIND = {
    "audio": ("mp3", "wav", "m4a", "ogg", "flac"), "video": ("mp4", "mkv", "avi", "mov", "webm"),
    "slide": ("pptx",), "doc": ("docx",), "pdf": ("pdf",), "text": ("txt", "md", "rtf"),
}
#: Words in names of transcripts.
NAME_WORDS = "(?i)(transcript|trascrizione|lezione|audio|registr|carne)"
#: Keywords of subjects, in order of precedence.
KEYWORDS = {
    "ingegneria": ("sistema", "controllo", "circuito", "segnale", "frequenza", "algoritmo", "complessità", "rete", "protocollo", "differenziale", "trasformata", "laplace", "fourier", "bode", "stabilità", "retroazione", "attuatore", "sensore", "pid", "programmazione", "compilatore", "cpu", "memoria", "kernel", "campionamento", "discreto", "matrici"),
    "matematica": ("teorema", "dimostrazione", "corollario", "lemma", "proposizione", "insieme", "funzione", "limite", "derivata", "integrale", "spazio vettoriale", "gruppo", "anello", "campo", "topologia", "convergenza", "continuità", "misura", "probabilità"),
    "fisica": ("forza", "energia", "massa", "accelerazione", "campo", "potenziale", "onda", "fotone", "elettrone", "quantistica", "termodinamica", "entropia", "hamiltoniano", "lagrangiana", "relatività", "ottica", "magnetismo", "vettore"),
    "medicina": ("paziente", "diagnosi", "terapia", "sintomo", "patologia", "farmaco", "dose", "anatomia", "fisiologia", "cellula", "recettore", "enzima", "metabolismo", "sindrome", "prognosi", "chirurgia", "esame", "laboratorio", "biopsia"),
    "economia": ("mercato", "prezzo", "domanda", "offerta", "equilibrio", "utilità", "profitto", "costo marginale", "elasticità", "pil", "inflazione", "tasso", "banca", "investimento", "bilancio", "contabilità", "asset", "portfolio"),
    "giurisprudenza": ("articolo", "comma", "norma", "legge", "decreto", "sentenza", "dottrina", "fattispecie", "contratto", "obbligazione", "responsabilità", "reato", "pena", "codice", "costituzione"),
}
GENERIC = "generico"
#: How templates prompt for notes.
PROMPTS = ("click to edit", "fare clic per modificare", "haga clic para editar", "zum bearbeiten klicken", "cliquez pour modifier")


def kind_of(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, names in KIND.items():
        out = F.when(F.lower(ext).isin(*names), kind).otherwise(out)
    return out


def is_transcript(text: Column) -> Column:
    """Whether enough lines begin with a time stamp: 30 % of up to ten, 10 % of more."""
    filled = F.filter(text_lines(text), lambda x: strip(x) != "")
    stamped = F.size(F.filter(filled, lambda x: strip(x).rlike(r"^\[\d{2}:\d{2}\]")))
    n = F.size(filled)
    return F.coalesce((n > 0) & (stamped / n >= F.when(n <= 10, 0.30).otherwise(0.10)), F.lit(False))


def ratio_transcript(stamped: Column, n: Column) -> Column:
    return (n > 0) & (stamped / n >= F.when(n <= 10, 0.30).otherwise(0.10))


def subject_scores(text: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """array<struct<score, ord, subject>>: how many distinct keywords each subject has in the text, as substrings."""

    def score(low: Column, words: tuple[str, ...]) -> Column:
        return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))

    return once(F.lower(text), lambda low: F.array(*[F.struct(score(low, words).alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("subject")) for i, (name, words) in enumerate(keywords.items())]))


def subject(text: Column, hint: Column | None = None, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """The subject with most keywords, at least two; ties go to the first declared. A hint that names one decides."""
    out = once(F.array_max(subject_scores(text, keywords)), lambda best: F.when(best.score >= 2, best.subject).otherwise(F.lit(GENERIC)))
    if hint is None:
        return out
    known = F.lit(None).cast("string")
    for name in reversed([*keywords, GENERIC]):
        known = F.when(F.contains(F.lower(hint), F.lit(name)) | F.contains(F.lit(name), F.lower(hint)), name).otherwise(known)
    return F.coalesce(F.when(hint != "", known), out)


def sample(slides: Column, transcript: Column) -> Column:
    return F.concat(F.substring(slides, 1, 3000), F.lit(" "), F.substring(transcript, 1, 2000))


def assign_roles(sources: DataFrame, lesson: str, seq: str, kind: str, name: str, text: str) -> DataFrame:
    """Adds role and has_audio.

    Slides are the skeleton, audio and video the flesh. A text file is flesh if it looks or is named like a
    transcript, or if there is a structure, no audio, and no flesh before it, which only the first text of a lesson
    can meet; else it is an aside. Documents are the skeleton where anything is spoken, else support.
    """
    w = Window.partitionBy(lesson)
    is_text = (F.col(kind) == "text") & (strip(F.col(text)) != "")
    d = sources.withColumns({
        "_hard": is_text & (is_transcript(F.col(text)) | F.col(name).rlike(NAME_WORDS)),
        "_struct": F.max(F.col(kind).isin("slide", "pdf", "doc")).over(w),
        "_audio": F.max(F.col(kind).isin("audio", "video")).over(w),
        "_first": F.min(F.when(is_text, F.col(seq))).over(w),
    })
    d = d.withColumn("_flesh", is_text & (F.col("_hard") | (F.col("_struct") & ~F.col("_audio") & (F.col(seq) == F.col("_first")))))
    d = d.withColumn("has_audio", F.col("_audio") | F.max(F.coalesce("_flesh", F.lit(False))).over(w))
    role = F.when(F.col(kind) == "slide", "SCHELETRO").when(F.col(kind).isin("audio", "video") | F.col("_flesh"), "CARNE").when(is_text, "CONTORNO")
    role = role.when(F.col(kind).isin("pdf", "doc"), F.when(F.col("has_audio"), "SCHELETRO").otherwise("SUPPORTO"))
    return d.withColumn("role", role).drop("_hard", "_struct", "_audio", "_first", "_flesh")


def synthesis_case(slides: Column, skeleton: Column, flesh: Column, support: Column) -> Column:
    """Which of the five instructions a lesson gets, with a mark if there is support."""
    case = F.when(slides & flesh, "slides+audio").when(slides, "slides").when(skeleton & flesh, "document+audio").when(flesh, "audio").when(skeleton, "document").otherwise("none")
    return F.concat(case, F.when(support, F.lit("+support")).otherwise(F.lit("")))


def is_formula_image(ext: Column, width: Column, height: Column, light: Column, dark: Column, saturation: Column) -> Column:
    """From an image's size and shares of light and of dark pixels and mean saturation: whether it shows a formula."""
    ok = ~F.lower(ext).isin("wmf", "emf", "svg") & (width >= 20) & (height >= 10) & (width / height >= 0.5) & ~((width > 2000) & (height > 800))
    return F.coalesce(ok & (light >= 0.5) & (dark >= 0.02) & (saturation <= 0.25), F.lit(False))


def pixel_formula(bar: Column, ink: Column) -> Column:
    """What a picture of a formula is taken for without a recogniser."""
    return F.when(bar, r"\frac{\cdot}{\cdot}").when(ink > 0.05, r"\text{[formula]}")


def notes_placeholder(note: Column) -> Column:
    """Speaker notes that are a template's prompt, mere decoration, or too short."""
    t = strip(note)
    prompt = t.rlike("(?iu)^(" + "|".join(PROMPTS) + ")")
    return F.coalesce(prompt | (strip(F.translate(t, "*—-.", "")) == "") | (F.length(t) < 3), F.lit(True))


#: The recogniser's names of languages, and what it reads where the language is not known.
OCR_LANGUAGE, OCR_ANY = {"it": "ita", "en": "eng"}, "eng+ita"


def ocr_language(lang: Column) -> Column:
    """The recogniser's languages for a language code (null: any)."""
    code = F.lower(strip(lang))
    out = F.lit(OCR_ANY)
    for name, known in OCR_LANGUAGE.items():
        out = F.when(code == name, known).otherwise(out)
    return out


def is_sparse(text: Column) -> Column:
    """Whether a page has too little text to do without recognition."""
    return F.length(strip(F.coalesce(text, F.lit("")))) < SPARSE


def first_valid(*answers: tuple[Column, Column]) -> Column:
    """The first answer of a cascade whose test holds."""
    return F.coalesce(*[F.when(ok, value) for value, ok in answers])
