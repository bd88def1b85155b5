"""Seeded labelled pages that the extraction model is trained on: invented words in the usual page skeletons."""

from __future__ import annotations

from functools import cache
from random import Random

# How pages usually name their parts, in English, German, French and Spanish.
CONTENT_NAMES = ["content", "article", "post", "entry", "main", "story", "body", "text", "artikel", "inhalt", "beitrag", "contenu", "texte", "contenido", "articulo", "texto", "page", "section", "block"]
BOILERPLATE_NAMES = {
    "menu": ["nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toolbar", "tabs", "links", "pagination", "pager", "hauptmenue", "navegacion", "brotkrumen"],
    "header": ["header", "masthead", "top", "logo", "branding", "kopfzeile", "kopf", "entete", "cabecera", "encabezado"],
    "footer": ["footer", "copyright", "bottom", "legal", "colophon", "imprint", "impressum", "fusszeile", "fuss", "pied", "pie"],
    "sidebar": ["sidebar", "aside", "related", "widget", "rail", "recommended", "popular", "trending", "tags", "share", "social", "seitenleiste", "verwandte", "teilen", "empfehlungen", "partager", "lateral", "relacionados", "compartir", "barra", "more", "teaser"],
    "notice": ["cookie", "notice", "banner", "alert", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "promo", "hinweis", "datenschutz", "abonnieren", "meldung", "avis", "abonnement", "aviso", "suscripcion", "privacy", "paywall", "overlay", "signup", "disclaimer"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "dfp", "werbung", "anzeige", "anzeigen", "publicite", "pub", "reclame", "publicidad", "anuncio", "anuncios", "patrocinado", "adsense", "adslot", "commercial"],
    "form": ["form", "search", "login", "signup", "formular", "suche", "anmeldung", "formulaire", "recherche", "connexion", "formulario", "buscar", "contact", "register"],
    "comment": ["comment", "comments", "discussion", "replies", "respond", "disqus", "kommentar", "kommentare", "diskussion", "leserbriefe", "commentaire", "commentaires", "comentario", "comentarios", "opiniones", "review", "reviews", "reply", "responses", "feedback", "bewertungen", "forum"],
}
SECTION_TAGS = {"menu": ["nav"], "header": ["header"], "footer": ["footer"], "sidebar": ["aside"], "form": ["form"]}


@cache
def _vocabulary() -> list[str]:
    r = Random(3)
    return ["".join(r.choice(["ba", "re", "to", "mi", "ku", "san", "del", "or", "ven"]) for _ in range(r.randint(1, 4))) for _ in range(400)]


def _sentence(r: Random, low: int, high: int) -> str:
    return " ".join(r.choices(_vocabulary(), k=r.randint(low, high))).capitalize() + r.choice([".", ".", ".", "!", ""])


def _links(r: Random, n: int) -> str:
    return "".join(f'<li><a href="/x">{_sentence(r, 1, 3)}</a></li>' for _ in range(n))


def _boilerplate(r: Random, kind: str) -> str:
    name = r.choice(BOILERPLATE_NAMES[kind])
    box = r.choice(["Box", "List", "Area", "Section", "Wrapper", "Container", "Block", "Item"])
    attr = r.choice([f'class="{name}"', f'id="{name}"', f'class="{name} {name}-box"', f'class="site-{name}"', f'class="user{name.title()}"', f'class="{name}{box}"', f'id="page{name.title()}{box}"'])
    tag = r.choice([*SECTION_TAGS.get(kind, []), "div", "section"] if kind != "comment" else ["div", "section", "ul"])
    if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6:
        attr = ""
    prose = "".join(f"<p>{_sentence(r, 4, 40)}</p>" for _ in range(r.randint(1, 3)))
    body = {
        "menu": f"<ul>{_links(r, r.randint(3, 8))}</ul>",
        "header": r.choice([f"<h1>{_sentence(r, 1, 4)}</h1>", prose, _sentence(r, 2, 8), f"<ul>{_links(r, 4)}</ul>"]),
        "footer": r.choice([_sentence(r, 3, 20), prose, f"<ul>{_links(r, 3)}</ul>{_sentence(r, 2, 10)}"]),
        "sidebar": r.choice([f"<h3>{_sentence(r, 1, 3)}</h3><ul>{_links(r, 5)}</ul>", prose, f"<h2>{_sentence(r, 1, 3)}</h2>{prose}"]),
        "notice": r.choice([_sentence(r, 5, 30), prose]),
        "advert": r.choice([_sentence(r, 3, 25), prose, f'<a href="/y">{_sentence(r, 3, 9)}</a>']),
        "form": f"<label>{_sentence(r, 1, 3)}</label><input name=q><p>{_sentence(r, 2, 12)}</p><select><option>{_sentence(r, 1, 2)}<option>{_sentence(r, 1, 2)}</select><textarea>{_sentence(r, 1, 9)}</textarea><button>{_sentence(r, 1, 2)}</button>",
        "comment": "".join(r.choice([f"<div class=comment><p>{_sentence(r, 4, 40)}</p></div>", f"<article class=comment><h4>{_sentence(r, 1, 2)}</h4><p>{_sentence(r, 4, 40)}</p></article>", f"<li>{_sentence(r, 4, 30)}</li>"]) for _ in range(r.randint(1, 4))),
    }[kind]
    return f"<{tag} {attr}>{body}</{tag}>"


def _aside(r: Random) -> str:
    """A control or the substitute of an object, within a line or alone: no part of the article."""
    tag = r.choice(["button", "noscript", "video", "audio", "object", "canvas", "svg", "select", "textarea"])
    return f"<{tag}>{_sentence(r, 1, r.choice([2, 12]))}</{tag}>"


def _content(r: Random, parts: list[str]) -> str:
    """The article's blocks in order, marked by a leading character that no other text has."""
    mark = "⁣"
    out = [f"<h1>{mark}{_sentence(r, 3, 12)}</h1>"] if r.random() < 0.8 else []
    lines = r.random() < 0.2
    for _ in range(r.randint(1, r.choice([3, 9, 9, 40]))):
        out.append(f"<p>{mark}{_sentence(r, 1, 4)}</p>" if lines else r.choice([
            f"<p>{mark}{_sentence(r, 2, 80)}</p>", f"<p>{mark}{_sentence(r, 20, 120)}</p>", f"<p>{mark}{_sentence(r, 1, 6)}<br>",
            f"<p>{mark}{_sentence(r, 10, 60)} <a href='/z'>{_sentence(r, 1, 4)}</a> {_sentence(r, 2, 9)}</p>",
            f"<h2>{mark}{_sentence(r, 1, 8)}</h2>", f"<blockquote>{mark}{_sentence(r, 5, 40)}</blockquote>",
            f"<ul><li>{mark}{_sentence(r, 2, 20)}</li><li>{mark}{_sentence(r, 2, 20)}</li></ul>",
            f"<ol><li>{mark}{_sentence(r, 2, 20)}<li>{mark}{_sentence(r, 2, 20)}</ol>",
            f"<table><tr><td>{mark}{_sentence(r, 1, 5)}</td><td>{mark}{_sentence(r, 1, 5)}</td></tr></table>",
            f"<p>{mark}{_sentence(r, 3, 30)}{_aside(r)} {_sentence(r, 3, 30)}</p>",
            f"<div>{mark}{_sentence(r, 5, 50)}</div>", f"<section><h3>{mark}{_sentence(r, 1, 5)}</h3><p>{mark}{_sentence(r, 5, 50)}</p></section>",
        ]))
        if parts and r.random() < 0.15:
            out.append(parts.pop())
        if r.random() < 0.05:
            out.append(_aside(r))
    return "".join(out)


def _bare(r: Random) -> str:
    """A page of one or a few short texts, alone, in some element or deep below plain ones."""
    texts = [f"\u2063{_sentence(r, 1, r.choice([3, 12, 40]))}" for _ in range(r.choice([1, 1, 2]))]
    core = "".join(r.choice([f"<p>{t}</p>", f"<div>{t}</div>", f"<h1>{t}</h1>", t + "<hr>"]) for t in texts)
    deep = r.choice([0, 0, 1, 3, 10, 40])
    return "<div>" * deep + core + "</div>" * deep


def labelled_pages(n: int = 500, seed: int = 5) -> list[str]:
    """Pages whose content texts start with U+2063; all other text is boilerplate."""
    r, pages = Random(seed), []
    for i in range(n):
        if i % 10 == 0:
            pages.append(_bare(r))
            continue
        kinds = [k for k in BOILERPLATE_NAMES if r.random() < 0.55]
        inside = [_boilerplate(r, r.choice(["advert", "sidebar", "form", "notice", "menu", "footer", "comment"])) for _ in range(r.randint(0, 2))]
        core = _content(r, inside)
        name = r.choice(CONTENT_NAMES)
        core = r.choice([f"<article>{core}</article>", f"<main>{core}</main>", f'<div class="{name}">{core}</div>', f'<div id="{name}">{core}</div>', f'<main><article class="{name}">{core}</article></main>', core, f"<div>{core}</div>"])
        before = [_boilerplate(r, k) for k in kinds if k in ("menu", "header", "notice", "advert", "form")]
        after = [_boilerplate(r, k) for k in kinds if k in ("footer", "sidebar", "comment", "advert")]
        page = "".join(before) + core + "".join(after)
        if r.random() < 0.3:
            page = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{page}</div>'
        pages.append(f"<html><head><title>x</title></head><body>{page}</body></html>")
    return pages
