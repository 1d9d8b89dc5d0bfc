import pytest

from lodestone.llm import syntax as S

SCRIPT = """HA$PBExportHeader$w_a.srw
$PBExportComments$it's (a note
/* open ( bracket
=======
*/
forward
global type w_a from window
end type
end forward

global w_a w_a
type variables
string is_a = "x~"(" // note
decimal{2} idc
end variables
forward prototypes
public function integer of_a (long al_row)
end prototypes

on w_a.create
call super::create
end on
Public Function integer of_a (long al_row);
if a = 1 and &
   b[2] > (3 + 4) then // block
\tx = 'it'
elseif y then
\tz = 1 ; y += 2
else
\tif q then return 0
End If
SELECT a, count(*)
  INTO :x FROM t
 WHERE b = 'it''s (' AND c = 1;
for i = 1 to 3
\tdo while a
\t\tdo
\t\tloop until b
\tloop
next
choose case x
\tcase 1, 2
\t\ttry
\t\t\ta = b
\t\tcatch (runtimeerror e)
\t\tend try
\tcase else
end choose
// <<<<<<< kept
return 1
end function
"""
REPORT = 'release 9;\ndatawindow(units=0 text="a (~" )" )\ntable(column=(type=char(5) name=a ) retrieve="SELECT\n=======\nb" )\n'
PIPELINE = 'PIPELINE(a=b)\nSOURCE(name="x",\n COLUMN(type=varchar,name="y"))\n'
PROJECT = "EXE:a.exe,,1,1,1\n\nCMP:1,0,0,2\nPBD:x.pbl,,1\nOBJ:a.pbl,w_b,w\n"


@pytest.mark.parametrize(("language", "text"), [("powerscript", SCRIPT), ("datawindow", REPORT), ("pipeline", PIPELINE), ("project", PROJECT)])
def test_valid_in_any_line_end(language, text):
    assert S.first_error(text, language) is None
    assert S.first_error(text.replace("\n", "\r\n"), language) is None
    assert S.first_error(text.rstrip("\n"), language) is None


BAD = [
    ("of_a (long al_row);", "of_a (long al_row)"), ("End If", "End"), ("End If", "End If;"), ("End If", ""), ("end choose", "end choose x"), ("\tcase 1, 2\n", "\telse\n"), ("next\n", "next i\n"), ("next\n", ""), ("end function\n", ""), ("end forward", "end forwards"),
    ("global w_a w_a", "global w_a"), ("global w_a w_a", "long x"), ("(3 + 4)", "(3 + 4"), ("b[2]", "b[2)"), ("'it'\n", "'it\n"), ("AND c = 1;", "AND c = 1"), ("*/", "*"), ("// <<<<<<< kept", "<<<<<<< HEAD"), ("// <<<<<<< kept", "======="), ("// <<<<<<< kept", ">>>>>>> main"),
    ("(long al_row)\nend proto", "(long al_row);\nend proto"), ("\t\tcatch", "\t\tend try\n\t\tcatch"), ("try\n", "tri\n"), ("loop until b", "loop until b\nloop"), ("return 1\nend function\n", "return 1\nend function\nend function\n"), ("call super::create\nend on", "call super::create end on"),
]


@pytest.mark.parametrize(("old", "new"), BAD)
def test_broken_scripts(old, new):
    assert old in SCRIPT
    assert S.first_error(SCRIPT.replace(old, new, 1), "powerscript") is not None


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("datawindow", ""), ("datawindow", REPORT.replace("release 9;", "")), ("datawindow", REPORT + "x"), ("datawindow", REPORT + "x("), ("datawindow", REPORT + ")"), ("datawindow", REPORT.replace('b" )', "b )")), ("datawindow", REPORT + '"s"'), ("datawindow", REPORT.replace("table(", "table(\n=======\n")),
        ("datawindow", "release 9;"), ("pipeline", REPORT), ("pipeline", PIPELINE[:-3]), ("pipeline", ""), ("project", ""), ("project", "\n\n"), ("project", "EXE:a,,1,1"), ("project", "EXE:a,,1,1, "), ("project", "exe:a,,1,1,1"), ("project", PROJECT + "<<<<<<< HEAD\n"), ("project", PROJECT + "NOTE"),
        ("powerscript", ""), ("powerscript", REPORT), ("powerscript", "global a b\n"), ("powerscript", "HA$PBExportHeader$x.sru\n"), ("datawindow", SCRIPT),
    ],
)
def test_broken_others(language, text):
    assert S.first_error(text, language) is not None


def test_deep_nesting_and_long_text_are_linear():
    deep = "on a\n" + "if x then\n" * 20_000 + "end if\n" * 20_000 + "end on\n"
    assert S.first_error(deep, "powerscript") is None
    assert S.first_error("release 1;\na(" + "(" * 50_000 + ")" * 50_000 + ")", "datawindow") is None


def test_error_names_line_and_token():
    e = S.first_error("on a\nif x then\nnext\nend on\n", "powerscript")
    assert (e.line, e.found) == (3, "next") and "end_if" in e.expected


def test_grammars_have_no_conflicts():
    for language in S.GRAMMARS:
        S.table(language)


def test_frame(spark):
    files = spark.createDataFrame([("r/a.pbl/w.srw", SCRIPT), ("r/a.pbl/d.SRD", REPORT), ("r/a.pbl/j.srj", "x"), ("q/a.pbl/n.sru", None), ("q/a.pbl/k.sru", REPORT)], "file string, lines string")
    objects = spark.createDataFrame([("r/a.pbl/w.srw", "powerscript"), ("r/a.pbl/w.srw", None), ("q/a.pbl/k.sru", "datawindow"), ("r/a.pbl/j.srj", "nonsense")], "file string, kind string")
    checked = S.check_files(S.with_language(files, objects))
    assert {(r.file, r.language, r.valid) for r in checked.collect()} == {("r/a.pbl/w.srw", "powerscript", True), ("r/a.pbl/d.SRD", "datawindow", True), ("r/a.pbl/j.srj", "project", False), ("q/a.pbl/k.sru", "datawindow", True)}
    assert {(r.repository, r.language): r.rate for r in S.rates(checked).collect()}[("r", "project")] == 1.0
    assert S.check_files(S.with_language(files.limit(0), objects)).count() == 0


def test_a_long_statement_takes_linear_time():
    import time

    from lodestone.llm.syntax import first_error

    head = "global type a from b\nend type\nsubroutine f ();\nx = "
    spent = []
    for n in (10_000, 40_000):
        text = head + " + ".join(f"a{i}('s')" for i in range(n)) + " &\n + 1\nend subroutine\n"
        began = time.perf_counter()
        assert first_error(text, "powerscript") is None
        spent.append(time.perf_counter() - began)
    assert spent[1] < 10 * spent[0] + 0.5


def test_what_stands_behind_a_semicolon():
    from lodestone.llm.syntax import first_error

    head = "global type a from b\nend type\nsubroutine f (); // c\n"
    for body, valid in (("select a from b where c = ';' ; /* x */ // y\n", True), ("select a from b; c\n;\n", True), ("if a then ; b\n", False), ("x = 1 & \n& \n + 2\n", True), ("x = 1 &", False)):
        assert (first_error(head + body + "end subroutine\n", "powerscript") is None) == valid, body
