"""Quality rules: line-first cleaning. Rules judge each line, failing lines go, and a text that loses too much is rejected.

Null and empty texts have no words, so they fail the base rule and are rejected. Repeated rows are judged each for
itself. Columns of the input other than the id and the text pass through `clean` untouched; its own columns are
prefixed by `quality_` and replace columns of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Words, chunks, raw, read, windows

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Parameters of the rules. Shares are of a line's words, or of a text's characters."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    #: A line fails if more of its words than this carry a run of symbols or of marks.
    max_marked_share: float = 0.3
    #: A line is navigation if it has so many separators, and more than this share of its words are separators.
    min_separators: int = 2
    max_separator_share: float = 0.15
    #: A line of this many words or more fails if its distinct words are under this share.
    distinct_from: int = 12
    min_distinct_share: float = 0.3
    #: A line without end punctuation of at most so many words that has a navigation word fails.
    nav_words_upto: int = 4
    #: A line is boilerplate if it has a phrase of such for each so many of its words: a long paragraph may mention one.
    words_a_phrase: int = 40
    #: A text is rejected if more than this share of its bytes stands on failing lines.
    max_lost_share: float = 0.6


_MARKED = re.compile(rb"(?:[#*$%&<>~^_=+]{2,}|[!?]{2,})")
_SEPARATOR = {b"|", b"||", b"/", b"\\", b">", b">>", b"<", b"\xc2\xbb", b"\xc2\xab", b"\xe2\x80\xba", b"\xe2\x80\xa2", b"\xc2\xb7", b"-", b"::"}
_END = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xc2\xbb", b"\xe3\x80\x82")
#: Words of menus and phrases of notices, by language.
_NAV_WORDS = (
    "home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|skip to|contact us|about us|sitemap|share|tweet|subscribe|read more|click here|add to cart",
    "startseite|anmelden|registrieren|suche|weiter|zurück|nach oben|kontakt|über uns|impressum|teilen|abonnieren|mehr lesen|weiterlesen|in den warenkorb",
    "accueil|connexion|se connecter|s'inscrire|rechercher|suivant|précédent|haut de page|contactez-nous|à propos|plan du site|partager|s'abonner|lire la suite|cliquez ici|ajouter au panier",
    "inicio|iniciar sesión|registrarse|buscar|siguiente|anterior|volver arriba|contacto|sobre nosotros|mapa del sitio|compartir|suscribirse|leer más|haga clic aquí|añadir al carrito",
)
_PHRASES = (
    r"all rights reserved|\bcopyright\b|©|cookie (?:policy|notice|settings)|accept (?:all )?cookies|privacy policy|terms (?:of|and) (?:use|service|conditions)|enable javascript|lorem ipsum|licen[sc]ed under|released under the|powered by",
    r"alle rechte vorbehalten|urheberrechtlich geschützt|cookie-(?:richtlinie|einstellungen)|(?:alle )?cookies akzeptieren|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen|javascript aktivieren|lizenziert unter|unter der lizenz",
    r"tous droits réservés|droits d.auteur|politique (?:de cookies|de confidentialité)|accepter (?:tous )?les cookies|mentions légales|conditions (?:d.utilisation|générales)|activer javascript|sous licence|propulsé par",
    r"todos los derechos reservados|derechos de autor|política de (?:cookies|privacidad)|aceptar (?:todas )?las cookies|aviso legal|(?:términos y condiciones|condiciones de uso)|activar javascript|bajo (?:la )?licencia|con la tecnología de",
)
#: A line without any of these has no such phrase.
_ANCHORS = (
    "rights", "copyright", "©", "cookie", "privacy", "terms", "javascript", "lorem", "licens", "licenc", "released", "powered", "rechte", "urheber", "datenschutz", "bedingungen",
    "lizenz", "droits", "confidentialité", "légales", "conditions", "propulsé", "derechos", "privacidad", "aviso", "términos", "condiciones", "tecnología",
)
_NAV = re.compile(rf"\b(?:{'|'.join(_NAV_WORDS)})\b", re.IGNORECASE)
_BOILERPLATE = re.compile("|".join(_PHRASES))


def line_rule(line: bytes, rules: Rules) -> str:
    """The name of the first rule that the line breaks; empty if none. A line without a word breaks none."""
    words = line.split()
    n = len(words)
    if not n:
        return ""
    if len(_MARKED.findall(line)) > rules.max_marked_share * n:
        return "punctuation"
    separators = sum(w in _SEPARATOR for w in words) if b"|" in line or b"/" in line or b">" in line or b"\xc2" in line or b"\xe2" in line or b"-" in line or b":" in line else 0
    if separators >= rules.min_separators and separators > rules.max_separator_share * n:
        return "navigation"
    if n <= rules.nav_words_upto and not line.rstrip().endswith(_END) and _NAV.search(line.decode()):
        return "navigation"
    if n >= rules.distinct_from and len(set(words)) < rules.min_distinct_share * n:
        return "repetition"
    low = line.decode().lower()
    if any(a in low for a in _ANCHORS) and len(_BOILERPLATE.findall(low)) * rules.words_a_phrase >= n:
        return "boilerplate"
    return ""


_OUT = T.StructType([T.StructField(f"quality_{n}", t) for n, t in (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
    ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("n_failed_lines", T.LongType()), ("lost_share", T.DoubleType()), ("text", T.StringType()),
)])


def _judge(texts: list[bytes], rules: Rules) -> dict[str, list]:
    words = Words(texts)
    k = rules.repeat_window
    at, h = windows(words.hashes(), words.text, k)
    keyed = h + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.start) + k + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + k, -1)
    covered = np.cumsum(cover)[: len(words.start)] > 0
    repeated = np.bincount(words.text[covered], minlength=len(texts))
    #: code points are the bytes that do not continue one
    heads = np.concatenate([[0], np.cumsum((words.buf & 0xC0) != 0x80)])
    chars = np.bincount(words.text, weights=heads[words.end] - heads[words.start], minlength=len(texts)).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(_SYMBOLS[words.buf])])
    symbols = marks[words.text_start + words.text_size] - marks[words.text_start]
    out: dict[str, list] = {f.name: [] for f in _OUT}
    for i, text in enumerate(texts):
        n = int(words.count[i])
        base = n < rules.min_words or 100 * int(repeated[i]) > rules.max_repeat_percent * n
        seen: set[bytes] = set()
        keep, dup, failed, lost, size = [], 0, 0, 0, 0
        for line in text.split(b"\n"):
            if not line or not line.strip(b" \t\r\x0b\x0c"):
                keep.append(line)
                continue
            size += len(line)
            if line in seen:
                dup += 1
                lost += len(line)
                failed += 1
                continue
            seen.add(line)
            if line_rule(line, rules):
                lost += len(line)
                failed += 1
            else:
                keep.append(line)
        share = lost / size if size else 0.0
        for name, value in zip(out, (n, int(chars[i]), int(symbols[i]), dup, int(repeated[i]), base, not base and share <= rules.max_lost_share, failed, share, b"\n".join(keep).decode()), strict=True):
            out[name].append(value)
    return out


def clean(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """docs with what the rules find: counts, base_failed, kept and the text without its failing lines, all as quality_*.

    One pass in Arrow batches without a shuffle; a task holds a few MB of text, or one document if that is longer.
    """
    rules = rules or Rules()
    docs = docs.drop(*[f.name for f in _OUT])
    schema = T.StructType([*docs.schema.fields, *_OUT.fields])
    types = {f.name: t for f, t in zip(_OUT.fields, (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.int64(), pa.float64(), pa.string()), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            found = _judge(raw(part.column(text)), rules)
            arrays = [pa.array(found[n], t) for n, t in types.items()]
            yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *types])

    return docs.mapInArrow(run, schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_failed_lines lost_share".split()
    return found.selectExpr("doc_id", *[f"quality_{n} AS {n}" for n in names])


#: The base columns; the method's verdict is tested against a brute-force version.
QUERIES = {"op5_quality_rules": op5_quality_rules}
