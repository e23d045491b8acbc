from graphweir.sources.code import defines, entities

PY = "import x\n\nclass Dog(Animal):\n    def bark(self):\n        pass\n\n    def\n  sit (self): pass\n"
JS = "function go (a) {\n}\nlater = function (b) {}\nclass Cat {\n  purr(x) {\n}}"
JAVA = "class A {\n  public int add(int a,\n     int b) { return a; }\n}"


def test_entities_of_four_languages(spark):
    rows = [("a.py", "Python", PY), ("b.js", "JavaScript", JS), ("c.java", "Java", JAVA), ("d.cs", "C#", JAVA), ("e.rs", "Rust", PY), ("f.py", "Python", None), ("g.py", "Python", "")]
    found = entities(spark.createDataFrame(rows, "path string, language string, content string"), "path", "content")
    got = {(r["path"], r["kind"], r["name"], r["start_line"], r["end_line"]) for r in found.collect()}
    java = lambda p: {(p, "Function", "add", 2, 3), (p, "Class", "A", 1, 1)}
    assert got == {
        ("a.py", "Class", "Dog", 3, 3), ("a.py", "Function", "bark", 4, 4), ("a.py", "Function", "sit", 7, 8),
        ("b.js", "Function", "go", 1, 1), ("b.js", "Function", "later", 3, 3), ("b.js", "Class", "Cat", 4, 4), ("b.js", "Function", "purr", 5, 5),
    } | java("c.java") | java("d.cs")
    edges = defines(found, "path").collect()
    assert len(edges) == len(got) and ("a.py", "a.py:Class:3:Dog", "DEFINES") in {tuple(e) for e in edges}
