"""Schemas of the typed records."""

FILE_SUMMARY = (
    "path string, mtime_ms double, imports array<struct<source:string,specifiers:array<string>>>, exports array<string>, "
    "re_exports array<string>, top_level_names array<string>, name_kinds array<struct<name:string,kind:string>>, "
    "has_default_export boolean, is_module boolean"
)
DECORATORS = "array<struct<name:string,args:array<string>>>"
PARAMS = "array<struct<name:string,type:string>>"
CODE_UNITS = (
    f"file_path string, name string, kind string, line int, exported boolean, is_async boolean, params {PARAMS}, return_type string, "
    f"members array<struct<name:string,kind:string,type:string,is_async:boolean,param_count:int,visibility:string,is_static:boolean,decorators:{DECORATORS}>>, "
    f"extends string, implements array<string>, decorators {DECORATORS}, constructor_params {PARAMS}, type_tokens array<string>, "
    "node_types array<string>, statement_types array<string>, body_line_count int, complexity int"
)
EDGES = "src string, dst string, source string"
CHANGE_SET = "op_id bigint, description string, path string, original string, modified string"
