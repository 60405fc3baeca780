import pytest

from orbweave.errors import QuerySyntaxError
from orbweave.plans.lexer import tokenize
from orbweave.plans.parser import Compare, Delete, Insert, Logic, Match, parse


def kinds(text):
    return [(t.kind, t.value) for t in tokenize(text)[:-1]]


def test_lexer_keywords_in_any_case():
    assert kinds("match Where RETURN") == [("keyword", "MATCH"), ("keyword", "WHERE"), ("keyword", "RETURN")]


def test_lexer_numbers_strings_and_arrows():
    assert kinds("42 3.14") == [("number", 42), ("number", 3.14)]
    assert kinds(r'"a\n\"b\q"') == [("string", 'a\n"bq')]
    assert [v for _, v in kinds("-> => <- - --> <-> <= >= !=")] == ["->", "=>", "<-", "-", "-->", "<->", "<=", ">=", "!="]


@pytest.mark.parametrize("text", ["1.2.3", '"open', "a ; b"])
def test_lexer_errors(text):
    with pytest.raises(QuerySyntaxError):
        tokenize(text)


def test_match_with_edge_where_and_limit():
    m = parse('MATCH (u:User)-[r:LIKES]->(t:Topic) WHERE u.age > 30 AND t.name = "x" RETURN u, t.name AS n ORDER BY n DESC LIMIT 5')
    assert isinstance(m, Match)
    assert (m.start.label, m.edge.relation, m.edge.direction, m.end.label) == ("User", "LIKES", "forward", "Topic")
    assert m.where == Logic("AND", Compare("u.age", ">", 30), Compare("t.name", "=", "x"))
    assert (m.items, m.order, m.limit) == ([("u", None), ("t.name", "n")], ("n", False), 5)


@pytest.mark.parametrize(
    "link, direction",
    [("-[r:X]->", "forward"), ("-[r:X]<-", "backward"), ("-[r:X]", "both"), ("<-[r:X]-", "backward"), ("-[r:X]-", "both"), ("->", "forward"), ("-->", "forward"), ("<-", "backward"), ("-", "both"), ("<->", "both"), ("=>", "forward")],
)
def test_directions(link, direction):
    assert parse(f"MATCH (a:A){link}(b:B)").edge.direction == direction


def test_relation_without_colon_is_no_alias():
    e = parse("MATCH (a)-[X]->(b)").edge
    assert (e.alias, e.relation) == (None, "X")


def test_precedence():
    intended = parse("MATCH (a) WHERE a.x = 1 AND a.y = 2 OR a.z = 3").where
    assert (intended.op, intended.left.op) == ("OR", "AND")
    strict = parse("MATCH (a) WHERE a.x = 1 AND a.y = 2 OR a.z = 3", strict_logic=True).where
    assert (strict.op, strict.right.op) == ("AND", "OR")


def test_insert_and_delete():
    assert parse('INSERT (User {name: "Al", age: -3, score: 1.5})') == Insert("User", {"name": "Al", "age": -3, "score": 1.5})
    assert parse("DELETE (u:User)") == Delete("u", "User")
    assert parse('MATCH (o:"Order")').start.label == "Order"


@pytest.mark.parametrize("text", ["", "FOO", "MATCH", "MATCH (a:Order)", "MATCH (a) extra", "MATCH (a) LIMIT 1.5", "INSERT (A {k:", "SELECT 1", "MATCH (a) WHERE a.x", "DELETE (:X)"])
def test_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)
