"""The term dictionaries, in order.  Each entry: term, names in Chinese and as a formula, aliases, patterns."""

from __future__ import annotations

from typing import NamedTuple


class Term(NamedTuple):
    term: str
    chinese_name: str
    formula: str | None
    aliases: tuple[str, ...]
    patterns: tuple[str, ...]


SURFACES = (
    Term("Mica", "云母", None, ("mica", "云母", "白云母", "钾云母", "muscovite", "fluorophlogopite"), (r"\bmica\b", r"\b云母\b", r"\bmuscovite\b", r"\bfluorophlogopite\b")),
    Term("HOPG", "高定向热解石墨", None, ("hopg", "高定向热解石墨", "高序热解石墨", "highly oriented pyrolytic graphite", "highly-ordered pyrolytic graphite", "pyrolytic graphite"), (r"\bhopg\b", r"\bhighly\s+oriented\s+pyrolytic\s+graphite\b", r"\bhighly-ordered\s+pyrolytic\s+graphite\b", r"\bpyrolytic\s+graphite\b", r"\b高定向热解石墨\b", r"\b高序热解石墨\b")),
    Term("Au(111)", "金电极", None, ("au(111)", "au111", "金电极", "金(111)", "金表面", "gold", "gold(111)", "gold surface", "au film", "gold film"), (r"\bau\(111\)\b", r"\bau111\b", r"\bgold\(111\)\b", r"\b金\(?111\)?\b", r"\b金电极\b", r"\bgold\s+(?:surface|film|substrate)\b", r"\bau\s+(?:surface|film|substrate)\b")),
    Term("Silica", "二氧化硅", None, ("silica", "二氧化硅", "石英", "sio2", "sio₂", " sio2 ", "silicon dioxide", "quartz", "fused silica"), (r"\bsilica\b", r"\bsio2\b", r"\bsio₂\b", r"\bsilicon\s+dioxide\b", r"\b二氧化硅\b", r"\b石英\b", r"\bquartz\b", r"\bfused\s+silica\b")),
    Term("Stainless steel", "不锈钢", None, ("stainless steel", "不锈钢", "不锈", "ss", "sus", "sus304", "304ss", "sus316", "316ss", "austenitic stainless steel", "martensitic stainless steel"), (r"\bstainless\s+steel\b", r"\b不锈钢\b", r"\bsus\d+\b", r"\b\d+ss\b", r"\b\d+\s* stainless\s+steel\b")),
    Term("Titanium", "钛", None, ("titanium", "钛", "纯钛", "ti", "cp ti", "cp-ti", "commercially pure titanium", "grade titanium"), (r"\btitanium\b", r"\b钛\b", r"\bcp[-\s]?ti\b", r"\bcommercially\s+pure\s+titanium\b", r"\bgrade\s*\d+\s*titanium\b", r"\btitanium\s+alloy\b")),
    Term("Graphite", "石墨", None, ("graphite", "石墨", "natural graphite"), (r"\bgraphite\b", r"\b石墨\b", r"\bnatural\s+graphite\b")),
)

LIQUIDS = (
    Term("[BMIM][PF6]", "1-丁基-3-甲基咪唑六氟磷酸盐", "C8H15F6N2P", ("[bmim][pf6]", "bmim pf6", "1-butyl-3-methylimidazolium hexafluorophosphate", "1-butyl-3-methylimidazolium pf6", "[c4mim][pf6]"), (r"\[?bmim\]?\s*\[?pf6\]?", r"\b1-butyl-3-methylimidazolium\s+hexafluorophosphate\b", r"\bc4mim\s+pf6\b")),
    Term("[BMIM][BF4]", "1-丁基-3-甲基咪唑四氟硼酸盐", "C8H15BF4N2", ("[bmim][bf4]", "bmim bf4", "1-butyl-3-methylimidazolium tetrafluoroborate", "1-butyl-3-methylimidazolium bf4", "[c4mim][bf4]"), (r"\[?bmim\]?\s*\[?bf4\]?", r"\b1-butyl-3-methylimidazolium\s+tetrafluoroborate\b")),
    Term("[EMIM][BF4]", "1-乙基-3-甲基咪唑四氟硼酸盐", "C6H11BF4N2", ("[emim][bf4]", "emim bf4", "1-ethyl-3-methylimidazolium tetrafluoroborate", "[c2mim][bf4]"), (r"\[?emim\]?\s*\[?bf4\]?", r"\b1-ethyl-3-methylimidazolium\s+tetrafluoroborate\b")),
    Term("[EMIM][TFSI]", "1-乙基-3-甲基咪唑双(三氟甲烷磺酰)亚胺盐", "C8H11F6N3O4S2", ("[emim][tfsi]", "emim tfsi", "[emim][ntf2]", "1-ethyl-3-methylimidazolium bis(trifluoromethylsulfonyl)imide", "1-ethyl-3-methylimidazolium tfsi"), (r"\[?emim\]?\s*\[?tfsi\]?", r"\[?emim\]?\s*\[?ntf2\]?", r"\b1-ethyl-3-methylimidazolium\s+bis\(trifluoromethylsulfonyl\)imide\b")),
    Term("[BMIM][TFSI]", "1-丁基-3-甲基咪唑双(三氟甲烷磺酰)亚胺盐", "C10H15F6N3O4S2", ("[bmim][tfsi]", "bmim tfsi", "[bmim][ntf2]", "1-butyl-3-methylimidazolium bis(trifluoromethylsulfonyl)imide"), (r"\[?bmim\]?\s*\[?tfsi\]?", r"\[?bmim\]?\s*\[?ntf2\]?")),
    Term("[HMIM][PF6]", "1-己基-3-甲基咪唑六氟磷酸盐", "C10H19F6N2P", ("[hmim][pf6]", "hmim pf6", "1-hexyl-3-methylimidazolium hexafluorophosphate", "[c6mim][pf6]"), (r"\[?hmim\]?\s*\[?pf6\]?", r"\b1-hexyl-3-methylimidazolium\s+hexafluorophosphate\b")),
    Term("[OMIM][PF6]", "1-辛基-3-甲基咪唑六氟磷酸盐", "C12H23F6N2P", ("[omim][pf6]", "omim pf6", "1-octyl-3-methylimidazolium hexafluorophosphate", "[c8mim][pf6]"), (r"\[?omim\]?\s*\[?pf6\]?", r"\b1-octyl-3-methylimidazolium\s+hexafluorophosphate\b")),
    Term("[BuPy][BF4]", "N-丁基吡啶四氟硼酸盐", "C9H14BF4N", ("[bupy][bf4]", "bupy bf4", "n-butylpyridinium tetrafluoroborate", "1-butylpyridinium tetrafluoroborate"), (r"\[?bupy\]?\s*\[?bf4\]?", r"\bn-butylpyridinium\s+tetrafluoroborate\b")),
    Term("[N4444][BTA]", "四丁基铵双(三氟甲烷磺酰)亚胺盐", "C20H36F6N2O4S2", ("[n4444][bta]", "[n4444][ntf2]", "tetrabutylammonium bis(trifluoromethylsulfonyl)imide", "[n4444][tfsi]"), (r"\[?n4444\]?\s*\[?(bta|ntf2|tfsi)\]?", r"\btetrabutylammonium\s+bis\(trifluoromethylsulfonyl\)imide\b")),
    Term("[P6,6,6,14][BTA]", "三己基十四烷基鏻双(三氟甲烷磺酰)亚胺盐", "C38H76F6NO4PS", ("[p6,6,6,14][bta]", "[p66614][bta]", "[p66614][ntf2]", "trihexyl(tetradecyl)phosphonium bis(trifluoromethylsulfonyl)imide", "[p66614][tfsi]", "p66614 bta", "p6,6,6,14][bta]"), (r"\[?p6[,\s]*6[,\s]*6[,\s]*14\]?\s*\[?(bta|ntf2|tfsi)\]?", r"\btrihexyl\(tetradecyl\)phosphonium\b")),
    Term("[P6,6,6,14][BOB]", "三己基十四烷基鏻双(草酸根)硼酸盐", "C38H76BO4P", ("[p66614][bob]", "trihexyl(tetradecyl)phosphonium bis(oxalato)borate", "p66614 bob", "[p6,6,6,14][bob]"), (r"\[?p6[,\s]*6[,\s]*6[,\s]*14\]?\s*\[?bob\]?", r"\btrihexyl\(tetradecyl\)phosphonium\s+bis\(oxalato\)borate\b")),
    Term("[P6,6,6,14][BMB]", "三己基十四烷基鏻双(丙二酸根)硼酸盐", "C40H80BO4P", ("[p6,6,6,14][bmb]", "[p66614][bmb]", "trihexyl(tetradecyl)phosphonium bis(malonato)borate", "p66614 bmb"), (r"\[?p6[,\s]*6[,\s]*6[,\s]*14\]?\s*\[?bmb\]?",)),
    Term("[P4,4,4,4][BTA]", "四丁基鏻双(三氟甲烷磺酰)亚胺盐", "C20H36F6NO4PS2", ("[p4,4,4,4][bta]", "[p4444][bta]", "[p4444][ntf2]", "tetrabutylphosphonium bis(trifluoromethylsulfonyl)imide"), (r"\[?p4[,\s]*4[,\s]*4[,\s]*4\]?\s*\[?(bta|ntf2|tfsi)\]?",)),
    Term("[P14][TFSI]", "N-甲基-N-丙基吡咯烷双(三氟甲烷磺酰)亚胺盐", "C10H18F6N2O4S2", ("[p14][tfsi]", "[p14][ntf2]", "n-methyl-n-propylpyrrolidinium bis(trifluoromethylsulfonyl)imide", "[py13][tfsi]"), (r"\[?p14\]?\s*\[?(tfsi|ntf2)\]?", r"\bn-methyl-n-propylpyrrolidinium\b")),
    Term("[Pyr13][TFSI]", "N-甲基-N-丙基吡咯烷双(三氟甲烷磺酰)亚胺盐", "C10H18F6N2O4S2", ("[pyr13][tfsi]", "n-methyl-n-propylpyrrolidinium tfsi"), (r"\[?pyr13\]?\s*\[?(tfsi|ntf2)\]?",)),
    Term("[hC3C1C1][TFSI]", "N,N,N',N'-四甲基-N-丙基胍双(三氟甲烷磺酰)亚胺盐", "C10H20F6N4O4S2", ("[hc3c1c1][tfsi]", "n,n,n',n'-tetramethyl-n-propylguanidinium tfsi"), (r"\[?hc3c1c1\]?\s*\[?(tfsi|ntf2)\]?",)),
    Term("[MOR11][TFSI]", "N-甲基-N-乙基吗啉双(三氟甲烷磺酰)亚胺盐", "C9H16F6N2O5S2", ("[mor11][tfsi]", "n-methyl-n-ethylmorpholinium tfsi"), (r"\[?mor11\]?\s*\[?(tfsi|ntf2)\]?",)),
    Term("[PIP14][TFSI]", "N-甲基-N-丁基哌啶双(三氟甲烷磺酰)亚胺盐", "C12H22F6N2O4S2", ("[pip14][tfsi]", "n-methyl-n-butylpiperidinium tfsi"), (r"\[?pip14\]?\s*\[?(tfsi|ntf2)\]?",)),
)
