"""A small language for plays: people 'id[:group][:sex][:nature]', stage(), move(), sp(), milestone()."""

from __future__ import annotations


def move(kind, who="", ana="", corresp=""):
    r = lambda x: " ".join("#" + i for i in x.split())
    at = "".join(f' {k}="{r(v)}"' for k, v in (("who", who), ("ana", ana), ("corresp", corresp)) if v)
    return f'<move type="{kind}"{at}/>'


def stage(*moves):
    return f"<stage>{''.join(moves)}</stage>"


def sp(who, *lines):
    r = " ".join("#" + i for i in who.split())
    return f'<sp who="{r}">{"".join(f"<l>{x}</l>" for x in lines) or "<l/>"}</sp>'


def milestone(unit, key, kind=""):
    return f'<milestone unit="{unit}" xml:id="{key}"' + (f' type="{kind}"' if kind else "") + "/>"


def tei(people, body, relations=(), title="Demo", urn="urn:cts:greekLit:tlg0019.tlg003.x"):
    listed = ""
    for p in people:
        key, *more = p.split(":")
        tag = "personGrp" if "group" in more else "person"
        more = [m for m in more if m != "group"]
        traits = "".join(f'<trait type="{t}" key="{v}"/>' for t, v in zip(("sex", "nature"), more, strict=False))
        listed += f'<{tag} xml:id="{key}"><persName xml:lang="en">{key.title()}</persName>{traits}</{tag}>'
    rel = "".join(f'<relation name="partOf" active="#{a}" passive="#{b}"/>' for a, b in relations)
    return f"""<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title xml:lang="en">{title}</title><author xml:lang="en">Aristophanes</author></titleStmt>
<publicationStmt><idno type="CTS-URN">{urn}</idno></publicationStmt></fileDesc><profileDesc><particDesc><listPerson>{listed}</listPerson><listRelation>{rel}</listRelation></particDesc></profileDesc></teiHeader>
<text><body><div>{''.join(body)}</div></body></text></TEI>"""
