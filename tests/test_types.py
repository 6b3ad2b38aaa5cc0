from tessera.types import BOOLEAN, FLOAT, INT, NULL, STRING, Type, list_of, optional, type_sum


def test_sums():
    assert str(type_sum(INT, NULL)) == "NULL | Int"
    assert str(type_sum(STRING, FLOAT)) == "Float | String"
    assert type_sum(type_sum(STRING, FLOAT), STRING) == type_sum(FLOAT, STRING)
    assert str(type_sum(list_of(INT), list_of(STRING))) == "[Int | String]"
    assert str(type_sum(optional(BOOLEAN), INT)) == "NULL | Int | Boolean"


def test_structs_merge_by_name():
    a, b = Type("Struct", fields=(("x", INT),)), Type("Struct", fields=(("a", STRING), ("x", STRING)))
    assert str(type_sum(a, b)) == "{a: NULL | String; x: Int | String}"
