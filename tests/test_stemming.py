"""The stemmer on the published sample of its vocabulary and on its rules."""

import duckdb

from strata.functions import stemming

SAMPLE = """consign consign,consigned consign,consigning consign,consignment consign,consist consist,consisted consist,consistency consist,consistent consist,consistently consist,consisting consist,consists consist,
consolation consol,consolations consol,consolatory consolatori,console consol,consoled consol,consoles consol,consolidate consolid,consolidated consolid,consolidating consolid,consoling consol,consolingly consol,consols consol,
consonant conson,consort consort,consorted consort,consorting consort,conspicuous conspicu,conspicuously conspicu,conspiracy conspiraci,conspirator conspir,conspirators conspir,conspire conspir,conspired conspir,conspiring conspir,
constable constabl,constables constabl,constance constanc,constancy constanc,constant constant,knack knack,knackeries knackeri,knacks knack,knag knag,knave knave,knaves knave,knavish knavish,kneaded knead,kneading knead,knee knee,
kneel kneel,kneeled kneel,kneeling kneel,kneels kneel,knees knee,knell knell,knelt knelt,knew knew,knick knick,knif knif,knife knife,knight knight,knightly knight,knights knight,knit knit,knits knit,knitted knit,knitting knit,knives knive,
knob knob,knobs knob,knock knock,knocked knock,knocker knocker,knockers knocker,knocking knock,knocks knock,knopp knopp,knot knot,knots knot"""
#: Words of each rule: plurals, past forms, short words, y, regions and exceptions.
RULES = """caresses caress,ties tie,cries cri,gas gas,this this,gaps gap,kiwis kiwi,bus bus,luxuriated luxuri,hopping hop,hoping hope,fizzed fizz,agreed agre,feed feed,bled bled,sing sing,by by,say say,cry cri,enjoy enjoy,youth youth,boyish boyish,
relational relat,conditional condit,rational ration,digitizer digit,operator oper,feudalism feudal,decisiveness decis,hopefulness hope,callousness callous,formality formal,sensitivity sensit,sensibility sensibl,analogy analog,geology geolog,
triplicate triplic,formative format,electrical electr,goodness good,revival reviv,allowance allow,inference infer,airliner airlin,adjustable adjust,defensible defens,irritant irrit,replacement replac,adoption adopt,activate activ,effective effect,
probate probat,rate rate,cease ceas,controller control,roll roll,skies sky,dying die,news news,inning inning,herring herring,succeed succeed,generate generat,general general,generic generic,communism communism,arsenal arsenal,
oxide oxid,oxides oxid,films film,film film,hafnium hafnium,annealed anneal,annealing anneal,deposition deposit,dielectrics dielectr,dielectric dielectr,hfo2 hfo2,a a,is is,2024 2024"""
PAIRS = dict(x.split() for x in (SAMPLE + "," + RULES).replace("\n", "").split(","))


def test_published_words(spark):
    got = {r.word: r.stem for r in stemming.stems(spark.createDataFrame([(w,) for w in [*PAIRS, None, ""]], "word string")).collect()}
    assert {w: got[w] for w in PAIRS if got[w] != PAIRS[w]} == {}
    assert got[None] is None and got[""] == ""


def test_duckdb_says_the_same():
    words = ", ".join(f"('{w}')" for w in PAIRS)
    got = dict(duckdb.sql(f"WITH words(word) AS (VALUES {words}) {stemming.duckdb_sql('words')}").fetchall())
    assert {w: got[w] for w in PAIRS if got[w] != PAIRS[w]} == {}
