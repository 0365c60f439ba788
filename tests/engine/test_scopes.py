from loomgraph.sources.extract import extract

JAVA = """package p;
class A {
  void m(Object o) {
    { Foo a = new Foo(); a.one(); }
    a.two();
    for (Item i : list) { i.three(); }
    i.four();
    if (o instanceof Bar b && b.five()) { b.six(); } else { b.seven(); }
    if (!(o instanceof Baz z)) { z.eight(); }
    try { x(); } catch (E1 | E2 e) { e.nine(); } catch (E3 e) { e.ten(); }
    switch (o) { case Foo f -> f.eleven(); case Bar g -> { g.twelve(); } default -> f.none(); }
    go(y -> y.thirteen(), (p, q) -> p.fourteen());
    y.fifteen();
  }
}"""
KOTLIN = """package p
class A(val s: Store) {
  fun m(x: Item) {
    x.apply { one(); this.two() }
    with(s) { three() }
    list.forEach { it.four() }
    it.five()
    list.map { a: Foo, b -> a.six(); b.seven() }
    for (k in xs) { k.eight() }
    k.nine()
    when (val w = Foo()) { is Foo -> w.ten() }
    w.eleven()
    if (x.ok()) { val y = Bar(); y.twelve() }
    y.thirteen()
    val z = x.run { fourteen() }
    try { a() } catch (e: Err) { e.fifteen() }
    s.let { sixteen() }
  }
}"""


def receivers(source, language):
    return {c["method_name"]: (c["receiver_type"], c["receiver_declared"], c["implicit_receiver_type"]) for c in extract(source, language)["calls"]}


def test_java_scopes_end_where_their_blocks_do():
    got = receivers(JAVA, "java")
    typed = {"one": "Foo", "three": "Item", "five": "Bar", "six": "Bar", "ten": "E3", "eleven": "Foo", "twelve": "Bar"}
    assert {k: v[0] for k, v in got.items() if v[0]} == typed
    assert {k for k, v in got.items() if v[0] is None and v[1]} == {"eight", "nine", "thirteen", "fourteen"}  # declared, of unknown type
    assert not any(got[k][1] for k in ("two", "four", "seven", "none", "fifteen"))


def test_kotlin_lambdas_and_receivers():
    got = receivers(KOTLIN, "kotlin")
    assert {k: v[2] for k, v in got.items() if v[2]} == {"one": "Item", "two": "Item", "three": "Store", "fourteen": "Item"}
    assert {k: v[0] for k, v in got.items() if v[0]} == {"apply": "Item", "six": "Foo", "ten": "Foo", "ok": "Item", "twelve": "Bar", "run": "Item", "fifteen": "Err", "let": "Store"}
    assert {k for k, v in got.items() if v[0] is None and v[1]} == {"four", "seven", "eight"}
    assert not any(got[k][1] for k in ("five", "nine", "eleven", "thirteen"))


def test_labelled_this():
    got = receivers("class A { inner class B { fun m() { this@A.go(); this@run.no() } } }", "kotlin")
    assert got["go"][:2] == ("A", True) and got["no"][:2] == (None, True)
