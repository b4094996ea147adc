"""Schemas of the tables the library reads and writes, as DDL text."""

FILES = "file_path string, code string"

SPECIFIER = (
    "struct<package:string,pos:int,specifier_type:string,import_type:string,"
    "import_stm:string,local_name:string,imported_name:string>"
)

ATTRIBUTES = "array<struct<name:string,value:string,kind:string,raw:string,start:int,stop:int>>"

USAGES = (
    "file_path string, rel_path string, package string, component string, "
    f"local_name string, resolved string, pos int, props map<string,string>, attrs {ATTRIBUTES}, import {SPECIFIER}"
)

# The rule document as it is written by hand or by the rule sink.  Match and
# set values are VARIANT so that boolean ``true`` and text "true" stay apart.
RULE_DOCUMENT = (
    "map<string,map<string,array<struct<"
    "`order`:int,`match`:array<map<string,variant>>,`set`:map<string,variant>,"
    "remove:array<string>,rename:map<string,string>,files:array<string>,"
    "newCompName:string,importFrom:string,importTo:string,"
    "replaceWith:struct<code:string,INNER_PROPS:array<string>>>>>>"
)

_TERM = "struct<key:string,value:string>"

# One rule.  ``any_of``: at least one clause must hold, a clause holds when all
# its terms do; ``none_of``: no term may hold.  A term without a value asks for
# the presence of the prop only.
RULE_FIELDS = (
    "package:string,component:string,rule_pos:BIGINT,rule_order:BIGINT,specificity:int,"
    f"any_of:array<array<{_TERM}>>,none_of:array<{_TERM}>,"
    "remove:array<string>,rename:array<struct<source:string,target:string>>,"
    "set:array<struct<key:string,value:string,literal:string>>,"
    "files:array<string>,new_component:string,import_from:string,import_to:string,"
    "template:string,inner_props:array<string>"
)
RULE = f"struct<{RULE_FIELDS}>"

SPEC = (
    "old struct<oldImportPath:string,compName:string>, "
    "new struct<newImportPath:string,importType:string,compName:string>"
)
