"""Recall and precision by kind on texts written for this test and not used to tune the patterns; entities stand in ⟦kind|…⟧."""

import re
from collections import Counter

from tamarisk.llm import pii

KNOWN = frozenset("maria jonas elena petrov okafor lindqvist tanaka duarte amara sofia keller moreau ibarra".split())
TEXTS = """
Please forward the invoice to ⟦email|accounts.payable@north-wind.example.org⟧ before Friday.
You can reach ⟦name|Elena Petrov⟧ on ⟦phone|+44 20 7946 0958⟧ or by mail at ⟦email|elena.petrov+work@mail.example.com⟧.
The parcel went to ⟦address|14 Harbour Street, Flat 3⟧ although the label named another house.
Her passport ⟦id_number|AB1234567⟧ expired in 2019, the new one is ⟦id_number|CD7654321⟧.
Dr. ⟦name|Okafor⟧ signed the discharge letter on 12 March 2021 at 14:30.
Call me on ⟦phone|07700 900123⟧ after six, not on the office line ⟦phone|020 7946 0018⟧.
A mailbox in words is spam-proof: ⟦email|jonas (at) example (dot) net⟧.
Social security number: ⟦id_number|123-45-6789⟧, policy year 2020-2021, page 12.
According to ⟦name|Jonas Lindqvist⟧, the bridge opened in 1932 and cost 4,500,000 crowns.
Nuestra oficina está en ⟦address|Calle Mayor 45⟧ y abre a las 9:00.
Pregunten por la Sra. ⟦name|Ibarra⟧ o llamen al ⟦phone|+34 915 550 123⟧.
Le rendez-vous est au ⟦address|12, rue de la Paix⟧, chez Mme ⟦name|Moreau⟧.
Die Wohnung liegt in der ⟦address|Lindenstraße 18⟧, zweiter Stock.
Version 2.10.4 fixed issue 20394 and took 1024 ms on 192.168.10.20.
Lake Elena and Mount Keller are both on the map of Port Maria.
The Maria Museum has 12 rooms and 340 paintings.
Contact person: ⟦name|Amara Duarte⟧, extension unknown, desk 4.
My number is ⟦phone|(555) 010-4477⟧ and hers is ⟦phone|555-010-4478⟧.
Order 4482910377 shipped on 2022-05-01, tracking 1Z9990039.
DNI ⟦id_number|45.678.901-X⟧, nacido en 1984, vive en ⟦address|Avenida Libertad 221, Piso 2⟧.
Reviewed-by: ⟦name|Sofia Tanaka⟧ <⟦email|sofia@dev.example.com⟧>
We saw 3 road trips, 12 street markets and 7 avenues of limes.
⟦name|Tanaka, Sofia⟧
Mr ⟦name|Keller⟧ and Ms ⟦name|Duarte⟧ met at noon by the old square.
The tax number ⟦id_number|20-30405060-7⟧ belongs to the shop at ⟦address|7 Mill Lane⟧.
She answered: "ask ⟦name|J. Petrov⟧ first", and left.
Insurance no ⟦id_number|QQ 12 34 56 C⟧; group 7; code 12-34-56.
Between 1911 and 1953 the tower held 20 bells; 5 remain.
""".strip().split("\n")


def parse(marked):
    text, truth, at = "", set(), 0
    for m in re.finditer(r"⟦(\w+)\|([^⟧]*)⟧", marked):
        text += marked[at : m.start()]
        truth.add((m[1], len(text)))
        text, at = text + m[2], m.end()
    return text + marked[at:], truth


def scores():
    """kind -> (true, found, both)"""
    c = Counter()
    for marked in TEXTS:
        text, truth = parse(marked)
        got = {(s.kind, s.start) for s in pii.find_spans(text, KNOWN)}
        for name, cases in (("true", truth), ("found", got), ("both", truth & got)):
            for kind, _ in cases:
                c[kind, name] += 1
    return {k: tuple(c[k, n] for n in ("true", "found", "both")) for k in pii.KINDS}


def test_recall_and_precision_by_kind():
    for kind, (true, found, both) in scores().items():
        assert both >= 0.9 * true and both >= 0.9 * found, (kind, true, found, both)
