"""Leaf blocks of a page's DOM, with the features that the extraction model reads."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of the HTML standard; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes".split())
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul button label ins".split())
SECTION = frozenset("article aside footer form header main nav section".split())
#: Start tag -> open elements that it ends.
ENDS = {
    **{t: frozenset(["p"]) for t in BLOCK - {"option", "optgroup", "button", "label"}},
    "li": frozenset(["p", "li"]),
    "dd": frozenset(["p", "dd", "dt"]),
    "dt": frozenset(["p", "dd", "dt"]),
    "tr": frozenset(["p", "td", "th", "tr"]),
    "td": frozenset(["p", "td", "th"]),
    "th": frozenset(["p", "td", "th"]),
    "option": frozenset(["option"]),
}
#: An implied end does not look beyond these.
FENCE = frozenset("ul ol dl table div section article aside nav main header footer form body blockquote td th".split())

#: A quote is one only behind an equals sign; a tag ends at the first > outside quotes that are closed.
_TOKEN = re.compile(
    r"(?P<comment><!--)"
    r"|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]++|=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?|[\"'])*+)>"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
#: What ends a comment; one that nothing ends is over at its next >, so that no text behind it is lost.
_COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_TOKENS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Context:
    """Where a block stands: features of its ancestors. ``children`` keeps contexts that were met before."""

    tag: str
    section: str
    features: frozenset[str]
    linked: bool = False
    children: dict = field(default_factory=dict, compare=False, repr=False)

    def child(self, tag: str, attrs: str) -> Context:
        key = (tag, attrs if "=" in attrs else "")
        c = self.children.get(key)
        if c is None:
            f = {f"t={tag}"}
            for m in _ATTR.finditer(attrs):
                words = _TOKENS.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower())
                f.update(f"c={w}" for w in words)
            section = self.section
            if tag in SECTION:
                f.update((f"in={tag}", f"{section}>{tag}"))
                section = tag
            kept = {x for x in self.features if not x.startswith("in=")} if tag in SECTION else self.features
            c = Context(tag, section, frozenset(kept | f), self.linked or tag == "a")
            if len(self.children) < 500:
                self.children[key] = c
        return c


ROOT = Context("", "", frozenset())


@dataclass
class Block:
    context: Context
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def blocks(page: str) -> list[Block]:
    """Runs of text that no block boundary divides, in page order; character references decoded, white space single."""
    out: list[Block] = []
    stack: list[Context] = [ROOT]
    nearest: list[Context] = [ROOT]  # the nearest block of each open element
    now: Block | None = None
    unclosed: set[str] = set()  # raw elements (and comments) that no later end closes

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                out.append(now)
            now = None

    def pop() -> None:
        if stack.pop().tag in BLOCK:
            close()
        nearest.pop()

    def end_head() -> None:
        """Content ends a head that is still open; within a title it does not."""
        tags = [c.tag for c in stack]
        if "head" in tags and "title" not in tags:
            while "head" in tags:
                pop()
                tags.pop()

    def behind(end: re.Pattern, name: str, at: int) -> int | None:
        """Where what stands at ``at`` is over; None if nothing ends it, which is looked for once a name."""
        found = None if name in unclosed else end.search(page, at)
        if found is None:
            unclosed.add(name)
            return None
        return found.end()

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m["comment"]:
            over = behind(_COMMENT_END, "!", at)
            at = over or page.find(">", at) + 1 or at
            continue
        tag = m["tag"]
        if tag is None:
            text = m["text"]
            if text is not None:
                if stack[-1].tag == "head" and not text.isspace():
                    end_head()
                if now is None:
                    if text.isspace():
                        continue
                    now = Block(nearest[-1])
                now.parts.append(text)
                if stack[-1].linked:
                    now.linked += len(text)
            continue
        tag = tag.lower()
        if not m["end"]:
            if tag not in HEAD:
                end_head()
            if tag in RAW:
                # its content is no markup: all up to its own end tag goes, or the tag alone if there is none
                if not m["attrs"].endswith("/"):
                    at = behind(_RAW_END[tag], tag, at) or at
                continue
            if tag == "br":
                if now is not None:
                    now.parts.append(" ")
                continue
            ends = ENDS.get(tag)
            if ends:
                i = len(stack) - 1
                last = None
                while i > 0 and (stack[i].tag in ends or stack[i].tag not in FENCE):
                    if stack[i].tag in ends:
                        last = i
                    i -= 1
                if last is not None:
                    while len(stack) > last:
                        pop()
            if tag in BLOCK:
                close()
            if tag in VOID:
                continue
            c = stack[-1].child(tag, m["attrs"])
            stack.append(c)
            nearest.append(c if tag in BLOCK else nearest[-1])
        else:
            if tag in BLOCK:
                close()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline end tag does not end a block
    close()
    return out


def features(b: Block) -> list[str]:
    """Ancestor features and text features of a block."""
    t = b.text
    n = t.count(" ") + 1
    share = b.linked / max(len(t), 1)
    f = [*b.context.features, f"at={b.context.tag}", f"words={min(n.bit_length(), 7)}", f"linked={min(int(share * 4), 3)}", "bias"]
    if t[-1] in ".!?\"”…":
        f.append("stop")
    if "©" in t or "(c)" in t:
        f.append("copyright")
    if t.count(",") > 1:
        f.append("commas")
    return f
