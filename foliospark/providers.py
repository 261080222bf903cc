"""What needs models or services: named providers, with deterministic stand-ins that need neither."""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("detect", "inpaint", "ocr", "translate", "translate_batch", "encode_image", "encode_pdf")
_REGISTRY: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, make: Callable) -> None:
    """``make()`` gives the provider; it is called once in each worker, as models are slow to load."""
    if kind not in KINDS:
        raise ValueError(f"no such kind of provider: {kind}")
    _REGISTRY[kind, name] = make


def provider(kind: str, name: str) -> Callable:
    try:
        return _REGISTRY[kind, name]()
    except KeyError:
        raise ValueError(f"no {kind} provider named {name}") from None


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _REGISTRY if k == kind)


def first_of(kind: str, wanted: list[str]) -> Callable:
    """The first of the named providers that can be made."""
    for name in wanted:
        try:
            return provider(kind, name)
        except Exception:  # noqa: BLE001 the next one is tried
            continue
    raise ValueError(f"none of {wanted} can serve as {kind}")


def echo(text: str) -> str:
    """A translation that can be told from its original: the text in quotation marks."""
    return f"«{text}»"


def echo_batch(texts: list[str], context: list[list[str]]) -> list[str]:
    """As ``echo`` for a page; a question mark makes the whole request fail."""
    if any("?" in t for t in texts):
        raise RuntimeError("the request was refused")
    return [echo(t) for t in texts]


def echo_model(prompt: str, request: str, tokens: int) -> str:
    """A model's answer in JSON as ``echo`` gives it; a text with a question mark gets none, which is no valid answer."""
    import json

    items = json.loads(request)["textos_a_traducir"]
    return json.dumps({"traducciones": [{"id": x["id"], "traduccion": echo(x["texto"])} for x in items if "?" not in x["texto"]]}, ensure_ascii=False)


register("translate", "echo", lambda: echo)
register("translate_batch", "echo", lambda: echo_batch)
