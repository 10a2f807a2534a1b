"""Results of the queries over the small project, read against its sources; fixed values.

``/p/#/`` stands for the folder of each copy. A row is columns in the order of ``COLUMNS``.
"""

COLUMNS = {
    "code_units": ['file_path', 'name', 'kind', 'line', 'exported', 'is_async', 'return_type', 'complexity', 'body_line_count'],
    "code_imports": ['path', 'source', 'specifiers', 'is_external'],
    "code_exports": ['path', 'name', 'is_default', 'is_re_export', 'source'],
    "code_light_units": ['file_path', 'name', 'kind', 'exported'],
    "code_members": ['file_path', 'name', 'member', 'kind', 'type', 'is_async', 'param_count', 'visibility', 'is_static'],
    "code_resolved_imports": ['src', 'source', 'specifiers', 'dst'],
    "code_dependencies": ['path', 'n_imports', 'n_imported_by', 'is_entry', 'is_leaf'],
    "code_call_graph": ['src', 'dst', 'pos'],
    "code_call_nodes": ['file_path', 'name', 'line', 'exported', 'is_test', 'calls'],
    "code_called_by": ['by_file', 'by_name', 'file_path', 'name'],
    "code_patterns": ['file_path', 'pattern', 'category', 'unit_name', 'line', 'confidence'],
    "code_pattern_evidence": ['file_path', 'pattern', 'unit_name', 'evidence', 'related_units'],
    "code_strategy": ['file_path', 'unit_name', 'line', 'confidence'],
    "code_structural_patterns": ['file_path', 'pattern', 'unit_name', 'confidence'],
    "code_file_exports": ['path', 'name', 'source'],
    "code_file_graph": ['direction', 'path'],
    "code_re_exports": ['path', 'source', 'names'],
    "code_search": ['file_path', 'name', 'kind', 'line'],
    "code_symbols": ['file_path', 'role'],
    "code_requires": ['path', 'source'],
    "cfg_blocks": ['file_path', 'function_name', 'id', 'type', 'label', 'statements', 'successors', 'predecessors', 'start_line', 'end_line'],
    "dfg_nodes": ['file_path', 'function_name', 'id', 'name', 'type', 'line', 'expression', 'source_file'],
    "dfg_edges": ['file_path', 'function_name', 'src', 'dst', 'type', 'label'],
    "code_references": ['path', 'name', 'pos', 'line', 'context', 'is_write', 'text'],
    "code_contexts": ['context', 'n'],
    "code_dead_exports": ['file_path', 'name'],
    "code_rename": ['path', 'removed', 'added'],
    "code_move": ['path', 'removed', 'added'],
    "code_extract_interface": ['path', 'removed', 'added'],
    "code_inline_variable": ['path', 'removed', 'added'],
    "code_change_signature": ['path', 'removed', 'added'],
    "code_to_arrow": ['path', 'removed', 'added'],
    "code_to_async": ['path', 'removed', 'added'],
    "code_convert_type": ['path', 'removed', 'added'],
    "code_modify": ['path', 'removed', 'added'],
    "code_encapsulate": ['path', 'removed', 'added'],
    "code_composition": ['path', 'removed', 'added'],
    "code_class_to_functions": ['path', 'removed', 'added'],
    "code_cjs_to_esm": ['path', 'removed', 'added'],
    "code_default_to_named": ['path', 'removed', 'added'],
    "code_safe_delete": ['path', 'removed', 'added'],
}

TYPES = {
    "code_units": ['string', 'string', 'string', 'int', 'boolean', 'boolean', 'string', 'int', 'int'],
    "code_imports": ['string', 'string', 'string', 'boolean'],
    "code_exports": ['string', 'string', 'boolean', 'boolean', 'string'],
    "code_light_units": ['string', 'string', 'string', 'boolean'],
    "code_members": ['string', 'string', 'string', 'string', 'string', 'boolean', 'int', 'string', 'boolean'],
    "code_resolved_imports": ['string', 'string', 'string', 'string'],
    "code_dependencies": ['string', 'bigint', 'bigint', 'boolean', 'boolean'],
    "code_call_graph": ['string', 'string', 'int'],
    "code_call_nodes": ['string', 'string', 'int', 'boolean', 'boolean', 'string'],
    "code_called_by": ['string', 'string', 'string', 'string'],
    "code_patterns": ['string', 'string', 'string', 'string', 'int', 'double'],
    "code_pattern_evidence": ['string', 'string', 'string', 'string', 'string'],
    "code_strategy": ['string', 'string', 'int', 'double'],
    "code_structural_patterns": ['string', 'string', 'string', 'double'],
    "code_file_exports": ['string', 'string', 'string'],
    "code_file_graph": ['string', 'string'],
    "code_re_exports": ['string', 'string', 'string'],
    "code_search": ['string', 'string', 'string', 'int'],
    "code_symbols": ['string', 'string'],
    "code_requires": ['string', 'string'],
    "cfg_blocks": ['string', 'string', 'int', 'string', 'string', 'string', 'string', 'string', 'int', 'int'],
    "dfg_nodes": ['string', 'string', 'int', 'string', 'string', 'int', 'string', 'string'],
    "dfg_edges": ['string', 'string', 'int', 'int', 'string', 'string'],
    "code_references": ['string', 'string', 'int', 'int', 'string', 'boolean', 'string'],
    "code_contexts": ['string', 'bigint'],
    "code_dead_exports": ['string', 'string'],
    "code_rename": ['string', 'string', 'string'],
    "code_move": ['string', 'string', 'string'],
    "code_extract_interface": ['string', 'string', 'string'],
    "code_inline_variable": ['string', 'string', 'string'],
    "code_change_signature": ['string', 'string', 'string'],
    "code_to_arrow": ['string', 'string', 'string'],
    "code_to_async": ['string', 'string', 'string'],
    "code_convert_type": ['string', 'string', 'string'],
    "code_modify": ['string', 'string', 'string'],
    "code_encapsulate": ['string', 'string', 'string'],
    "code_composition": ['string', 'string', 'string'],
    "code_class_to_functions": ['string', 'string', 'string'],
    "code_cjs_to_esm": ['string', 'string', 'string'],
    "code_default_to_named": ['string', 'string', 'string'],
    "code_safe_delete": ['string', 'string', 'string'],
}

ROWS = {
    "code_units": [
        ('/p/#/src/app.tsx', 'App', 'function', 4, True, False, '', 0, 4),
        ('/p/#/src/app.tsx', 'useShapes', 'function', 8, True, False, '', 0, 1),
        ('/p/#/src/make.ts', 'createShape', 'function', 4, True, False, 'Promise<Shape[]>', 5, 8),
        ('/p/#/src/make.ts', 'log', 'arrow', 13, False, False, 'void', 0, 1),
        ('/p/#/src/make.ts', 'scale', 'arrow', 12, True, True, '', 0, 1),
        ('/p/#/src/shapes.ts', 'Disc', 'class', 7, True, False, '', 0, 5),
        ('/p/#/src/shapes.ts', 'Shape', 'interface', 1, True, False, '', 0, 0),
        ('/p/#/src/shapes.ts', 'Square', 'class', 2, True, False, '', 0, 5),
        ('/p/#/src/store.ts', 'ShapeStore', 'class', 3, True, False, '', 0, 9),
        ('/p/lib/util.js', 'unused', 'function', 4, False, False, '', 2, 1),
    ],
    "code_imports": [
        ('/p/#/src/app.tsx', './index.js', 'createShape', False),
        ('/p/#/src/app.tsx', '@/util', 'log', True),
        ('/p/#/src/app.tsx', 'react', 'default,useState', True),
        ('/p/#/src/index.ts', './make', 'createShape', False),
        ('/p/#/src/index.ts', './make', 'scale', False),
        ('/p/#/src/index.ts', './shapes', '*', False),
        ('/p/#/src/index.ts', './store', 'ShapeStore', False),
        ('/p/#/src/make.ts', './shapes', 'Shape', False),
        ('/p/#/src/make.ts', './shapes', 'Square,Disc', False),
        ('/p/#/src/store.ts', 'events', 'EventEmitter', True),
        ('/p/lib/util.js', 'fs', 'default', True),
    ],
    "code_exports": [
        ('/p/#/src/app.tsx', 'App', False, False, None),
        ('/p/#/src/app.tsx', 'default', True, False, None),
        ('/p/#/src/app.tsx', 'useShapes', False, False, None),
        ('/p/#/src/index.ts', '*', False, True, './shapes'),
        ('/p/#/src/index.ts', 'ShapeStore', False, True, './store'),
        ('/p/#/src/index.ts', 'createShape', False, True, './make'),
        ('/p/#/src/index.ts', 'factor', False, True, './make'),
        ('/p/#/src/make.ts', 'createShape', False, False, None),
        ('/p/#/src/make.ts', 'scale', False, False, None),
        ('/p/#/src/shapes.ts', 'Disc', False, False, None),
        ('/p/#/src/shapes.ts', 'Shape', False, False, None),
        ('/p/#/src/shapes.ts', 'Square', False, False, None),
        ('/p/#/src/store.ts', 'ShapeStore', False, False, None),
        ('/p/lib/util.js', 'read', False, False, None),
        ('/p/lib/util.js', 'write', False, False, None),
    ],
    "code_light_units": [
        ('/p/#/src/app.tsx', 'App', 'function', True),
        ('/p/#/src/app.tsx', 'useShapes', 'function', True),
        ('/p/#/src/make.ts', 'createShape', 'function', True),
        ('/p/#/src/make.ts', 'log', 'variable', False),
        ('/p/#/src/make.ts', 'scale', 'variable', True),
        ('/p/#/src/shapes.ts', 'Disc', 'class', True),
        ('/p/#/src/shapes.ts', 'Shape', 'interface', True),
        ('/p/#/src/shapes.ts', 'Square', 'class', True),
        ('/p/#/src/store.ts', 'ShapeStore', 'class', True),
        ('/p/lib/util.js', 'fs', 'variable', False),
        ('/p/lib/util.js', 'unused', 'function', False),
    ],
    "code_members": [
        ('/p/#/src/shapes.ts', 'Disc', 'area', 'method', None, False, 0, 'public', False),
        ('/p/#/src/shapes.ts', 'Disc', 'constructor', 'constructor', None, False, 1, 'public', False),
        ('/p/#/src/shapes.ts', 'Disc', 'constructor', 'method', None, False, 1, 'public', False),
        ('/p/#/src/shapes.ts', 'Disc', 'name', 'property', 'string', False, None, 'public', False),
        ('/p/#/src/shapes.ts', 'Shape', 'area', 'method', None, False, 0, 'public', False),
        ('/p/#/src/shapes.ts', 'Shape', 'name', 'property', 'string', False, None, 'public', False),
        ('/p/#/src/shapes.ts', 'Square', 'area', 'method', None, False, 0, 'public', False),
        ('/p/#/src/shapes.ts', 'Square', 'constructor', 'constructor', None, False, 1, 'public', False),
        ('/p/#/src/shapes.ts', 'Square', 'constructor', 'method', None, False, 1, 'public', False),
        ('/p/#/src/shapes.ts', 'Square', 'name', 'property', None, False, None, 'public', False),
        ('/p/#/src/store.ts', 'ShapeStore', 'constructor', 'constructor', None, False, 1, 'private', False),
        ('/p/#/src/store.ts', 'ShapeStore', 'constructor', 'method', None, False, 1, 'private', False),
        ('/p/#/src/store.ts', 'ShapeStore', 'delete', 'method', None, True, 1, 'public', False),
        ('/p/#/src/store.ts', 'ShapeStore', 'emit', 'method', None, False, 1, 'public', False),
        ('/p/#/src/store.ts', 'ShapeStore', 'find', 'method', None, False, 1, 'public', False),
        ('/p/#/src/store.ts', 'ShapeStore', 'getInstance', 'method', None, False, 0, 'public', True),
        ('/p/#/src/store.ts', 'ShapeStore', 'instance', 'property', 'ShapeStore', False, None, 'private', True),
        ('/p/#/src/store.ts', 'ShapeStore', 'on', 'method', None, False, 1, 'public', False),
        ('/p/#/src/store.ts', 'ShapeStore', 'save', 'method', None, False, 1, 'public', False),
    ],
    "code_resolved_imports": [
        ('/p/#/src/app.tsx', './index.js', 'createShape', '/p/#/src/index.ts'),
        ('/p/#/src/app.tsx', '@/util', 'log', '/p/lib/util.js'),
        ('/p/#/src/app.tsx', 'react', 'default,useState', None),
        ('/p/#/src/index.ts', './make', 'createShape', '/p/#/src/make.ts'),
        ('/p/#/src/index.ts', './make', 'scale', '/p/#/src/make.ts'),
        ('/p/#/src/index.ts', './shapes', '*', '/p/#/src/shapes.ts'),
        ('/p/#/src/index.ts', './store', 'ShapeStore', '/p/#/src/store.ts'),
        ('/p/#/src/make.ts', './shapes', 'Shape', '/p/#/src/shapes.ts'),
        ('/p/#/src/make.ts', './shapes', 'Square,Disc', '/p/#/src/shapes.ts'),
        ('/p/#/src/store.ts', 'events', 'EventEmitter', None),
        ('/p/lib/util.js', 'fs', 'default', None),
    ],
    "code_dependencies": [
        ('/p/#/src/app.tsx', 2, 0, True, False),
        ('/p/#/src/index.ts', 4, 1, False, False),
        ('/p/#/src/make.ts', 2, 1, False, False),
        ('/p/#/src/shapes.ts', 0, 2, False, True),
        ('/p/#/src/store.ts', 0, 1, False, True),
    ],
    "code_call_graph": [
        ('/p/#/src/app.tsx:App', '/p/0/src/make.ts:createShape', 225),
        ('/p/#/src/app.tsx:useShapes', '/p/0/src/make.ts:createShape', 318),
        ('/p/#/src/make.ts:createShape', '/p/0/src/make.ts:log', 401),
        ('/p/#/src/make.ts:createShape', '/p/0/src/make.ts:scale', 325),
    ],
    "code_call_nodes": [
        ('/p/#/src/app.tsx', 'App', 4, True, False, 'useState,createShape'),
        ('/p/#/src/app.tsx', 'useShapes', 8, True, False, 'createShape'),
        ('/p/#/src/make.ts', 'createShape', 4, True, False, 'Promise.resolve,scale,test,log,Promise.resolve'),
        ('/p/#/src/make.ts', 'log', 13, False, False, 'console.log'),
        ('/p/#/src/make.ts', 'scale', 12, True, False, ''),
        ('/p/lib/util.js', 'unused', 4, False, False, ''),
    ],
    "code_called_by": [
        ('/p/#/src/app.tsx', 'App', '/p/0/src/make.ts', 'createShape'),
        ('/p/#/src/app.tsx', 'useShapes', '/p/0/src/make.ts', 'createShape'),
        ('/p/#/src/make.ts', 'createShape', '/p/0/src/make.ts', 'log'),
        ('/p/#/src/make.ts', 'createShape', '/p/0/src/make.ts', 'scale'),
    ],
    "code_patterns": [
        ('/p/#/src/index.ts', 'barrel-module', 'architectural', '/p/#/src/index.ts', 1, 0.95),
        ('/p/#/src/shapes.ts', 'adapter', 'structural', 'Disc', 7, 0.65),
        ('/p/#/src/shapes.ts', 'adapter', 'structural', 'Square', 2, 0.65),
        ('/p/#/src/shapes.ts', 'strategy', 'behavioral', 'Shape', 1, 0.8),
        ('/p/#/src/store.ts', 'composite', 'structural', 'ShapeStore', 3, 0.6),
        ('/p/#/src/store.ts', 'dependency-injection', 'architectural', 'ShapeStore', 3, 0.9),
        ('/p/#/src/store.ts', 'observer', 'behavioral', 'ShapeStore', 3, 0.9),
        ('/p/#/src/store.ts', 'repository', 'architectural', 'ShapeStore', 3, 0.8),
        ('/p/#/src/store.ts', 'singleton', 'creational', 'ShapeStore', 3, 0.95),
        ('/p/0/src/app.tsx', 'react-components', 'framework', 'App', 4, 0.9),
        ('/p/0/src/app.tsx', 'react-hooks', 'framework', 'useShapes', 8, 0.95),
        ('/p/0/src/store.ts', 'angular-services', 'framework', 'ShapeStore', 3, 0.95),
    ],
    "code_pattern_evidence": [
        ('/p/#/src/index.ts', 'barrel-module', '/p/#/src/index.ts', '', ''),
        ('/p/#/src/shapes.ts', 'adapter', 'Disc', 'takes number; implements Shape', ''),
        ('/p/#/src/shapes.ts', 'adapter', 'Square', 'takes number; implements Shape', ''),
        ('/p/#/src/shapes.ts', 'strategy', 'Shape', 'implementations @2N', 'Disc,Square'),
        ('/p/#/src/store.ts', 'composite', 'ShapeStore', '', ''),
        ('/p/#/src/store.ts', 'dependency-injection', 'ShapeStore', 'takes ApiClient', ''),
        ('/p/#/src/store.ts', 'observer', 'ShapeStore', 'extends EventEmitter; methods on, emit', ''),
        ('/p/#/src/store.ts', 'repository', 'ShapeStore', 'methods find, save, delete', ''),
        ('/p/#/src/store.ts', 'singleton', 'ShapeStore', 'private constructor; static instance', ''),
    ],
    "code_strategy": [
        ('/p/#/src/shapes.ts', 'Shape', 1, 0.8),
    ],
    "code_structural_patterns": [
        ('/p/#/src/shapes.ts', 'adapter', 'Disc', 0.65),
        ('/p/#/src/shapes.ts', 'adapter', 'Square', 0.65),
        ('/p/#/src/store.ts', 'composite', 'ShapeStore', 0.6),
    ],
    "code_file_exports": [
        ('0/src/index.ts', '*', './shapes'),
        ('0/src/index.ts', 'ShapeStore', './store'),
        ('0/src/index.ts', 'createShape', './make'),
        ('0/src/index.ts', 'factor', './make'),
    ],
    "code_file_graph": [
        ('imported by', '/p/0/src/index.ts'),
        ('imports', '/p/0/src/shapes.ts'),
    ],
    "code_re_exports": [
        ('/p/#/src/index.ts', './make', 'createShape,factor'),
        ('/p/#/src/index.ts', './shapes', '*'),
        ('/p/#/src/index.ts', './store', 'ShapeStore'),
    ],
    "code_search": [
        ('/p/#/src/make.ts', 'createShape', 'function', 4),
    ],
    "code_symbols": [
        ('/p/#/src/app.tsx', 'reference'),
        ('/p/#/src/index.ts', 'reference'),
        ('/p/#/src/make.ts', 'definition'),
    ],
    "code_requires": [
        ('/p/lib/util.js', 'fs'),
    ],
    "cfg_blocks": [
        ('/p/#/src/app.tsx', 'App', 0, 'entry', 'entry', '', '2', '', 4, 4),
        ('/p/#/src/app.tsx', 'App', 1, 'exit', 'exit', '', '', '2', 4, 4),
        ('/p/#/src/app.tsx', 'App', 2, 'body', 'body', "const [n, setN] = useState(0) | return <div onClick={() => { createShape('disc', n); }}>{title}</div>", '1', '0', 4, 6),
        ('/p/#/src/app.tsx', 'useShapes', 0, 'entry', 'entry', '', '2', '', 8, 8),
        ('/p/#/src/app.tsx', 'useShapes', 1, 'exit', 'exit', '', '', '2', 8, 8),
        ('/p/#/src/app.tsx', 'useShapes', 2, 'body', 'body', 'return createShape(kind, 1)', '1', '0', 8, 8),
        ('/p/#/src/make.ts', 'createShape', 0, 'entry', 'entry', '', '2', '', 4, 4),
        ('/p/#/src/make.ts', 'createShape', 1, 'exit', 'exit', '', '', '4,8', 4, 4),
        ('/p/#/src/make.ts', 'createShape', 2, 'body', 'body', '', '3', '0', 4, 4),
        ('/p/#/src/make.ts', 'createShape', 3, 'branch', "if (kind === 'square' && size ", "if (kind === 'square' && size > 0)", '4,5', '2', 5, 5),
        ('/p/#/src/make.ts', 'createShape', 4, 'body', 'then', 'return Promise.resolve([new Square(size)])', '1', '3', 5, 6),
        ('/p/#/src/make.ts', 'createShape', 5, 'body', 'merge', 'const why = kind === "disc" ? `a ${kind} of ${scale(size)}` : /di[s/]c/.test(kin', '6', '3', 8, 8),
        ('/p/#/src/make.ts', 'createShape', 6, 'loop', 'for (const k of [1, 2])', 'for (const k of [1, 2])', '7,8', '5,7', 9, 9),
        ('/p/#/src/make.ts', 'createShape', 7, 'body', 'loop body', 'log(why + k)', '6', '6', 9, 9),
        ('/p/#/src/make.ts', 'createShape', 8, 'body', 'after loop', 'return Promise.resolve([new Disc(size)])', '1', '6', 10, 10),
        ('/p/lib/util.js', 'unused', 0, 'entry', 'entry', '', '2', '', 4, 4),
        ('/p/lib/util.js', 'unused', 1, 'exit', 'exit', '', '', '4,5', 4, 4),
        ('/p/lib/util.js', 'unused', 2, 'body', 'body', '', '3', '0', 4, 4),
        ('/p/lib/util.js', 'unused', 3, 'switch', 'switch (fs.x)', 'switch (fs.x)', '4,5', '2', 4, 4),
        ('/p/lib/util.js', 'unused', 4, 'case', 'case 1', 'return 1', '1', '3', 4, 4),
        ('/p/lib/util.js', 'unused', 5, 'case', 'default', 'return 2', '1', '3', 4, 4),
    ],
    "dfg_nodes": [
        ('/p/#/src/app.tsx', 'App', 0, '{ title }', 'parameter', 4, None, None),
        ('/p/#/src/app.tsx', 'App', 1, '[n, setN]', 'definition', 5, 'useState(0)', None),
        ('/p/#/src/app.tsx', 'App', 2, 'useState', 'call', 5, 'useState(0)', None),
        ('/p/#/src/app.tsx', 'App', 3, 'return', 'return', 6, "<div onClick={() => { createShape('disc', n); }}>{title}</di", None),
        ('/p/#/src/app.tsx', 'useShapes', 0, 'kind', 'parameter', 8, None, None),
        ('/p/#/src/app.tsx', 'useShapes', 1, 'return', 'return', 8, 'createShape(kind, 1)', None),
        ('/p/#/src/app.tsx', 'useShapes', 2, 'kind', 'usage', 8, None, None),
        ('/p/#/src/make.ts', 'createShape', 0, 'kind', 'parameter', 4, None, None),
        ('/p/#/src/make.ts', 'createShape', 1, 'size', 'parameter', 4, None, None),
        ('/p/#/src/make.ts', 'createShape', 10, '/di[s/]c/.test', 'call', 8, '/di[s/]c/.test(kind)', None),
        ('/p/#/src/make.ts', 'createShape', 11, 'k', 'definition', 9, None, None),
        ('/p/#/src/make.ts', 'createShape', 12, 'return', 'return', 10, 'Promise.resolve([new Disc(size)])', None),
        ('/p/#/src/make.ts', 'createShape', 13, 'size', 'usage', 10, None, None),
        ('/p/#/src/make.ts', 'createShape', 2, 'return', 'return', 6, 'Promise.resolve([new Square(size)])', None),
        ('/p/#/src/make.ts', 'createShape', 3, 'size', 'usage', 6, None, None),
        ('/p/#/src/make.ts', 'createShape', 4, 'why', 'definition', 8, 'kind === "disc" ? `a ${kind} of ${scale(size)}` : /di[s/]c/.', None),
        ('/p/#/src/make.ts', 'createShape', 5, 'kind', 'usage', 8, None, None),
        ('/p/#/src/make.ts', 'createShape', 6, 'kind', 'usage', 8, None, None),
        ('/p/#/src/make.ts', 'createShape', 7, 'size', 'usage', 8, None, None),
        ('/p/#/src/make.ts', 'createShape', 8, 'kind', 'usage', 8, None, None),
        ('/p/#/src/make.ts', 'createShape', 9, 'scale', 'call', 8, 'scale(size)', None),
        ('/p/lib/util.js', 'unused', 0, 'return', 'return', 4, '1', None),
        ('/p/lib/util.js', 'unused', 1, 'return', 'return', 4, '2', None),
    ],
    "dfg_edges": [
        ('/p/#/src/app.tsx', 'useShapes', 0, 2, 'def-use', None),
        ('/p/#/src/make.ts', 'createShape', 0, 10, 'call-arg', 'kind'),
        ('/p/#/src/make.ts', 'createShape', 0, 5, 'def-use', None),
        ('/p/#/src/make.ts', 'createShape', 0, 6, 'def-use', None),
        ('/p/#/src/make.ts', 'createShape', 0, 8, 'def-use', None),
        ('/p/#/src/make.ts', 'createShape', 1, 13, 'def-use', None),
        ('/p/#/src/make.ts', 'createShape', 1, 3, 'def-use', None),
        ('/p/#/src/make.ts', 'createShape', 1, 7, 'def-use', None),
        ('/p/#/src/make.ts', 'createShape', 1, 9, 'call-arg', 'size'),
    ],
    "code_references": [
        ('/p/0/src/index.ts', 'createShape', 35, 2, 'export', False, "export { createShape, scale as factor } from './make'"),
        ('/p/0/src/make.ts', 'createShape', 126, 4, 'definition', True, 'export function createShape(kind: string, size: number): Promise<Shape[]> {'),
    ],
    "code_contexts": [
        ('definition', 1),
        ('import', 1),
        ('usage', 1),
    ],
    "code_dead_exports": [
        ('/p/#/src/app.tsx', 'App'),
        ('/p/#/src/app.tsx', 'useShapes'),
        ('/p/lib/util.js', 'read'),
        ('/p/lib/util.js', 'write'),
    ],
    "code_rename": [
        ('/p/0/src/index.ts', "export { createShape, scale as factor } from './make';", "export { makeShape as createShape, scale as factor } from './make';"),
        ('/p/0/src/make.ts', 'export function createShape(kind: string, size: number): Promise<Shape[]> {', 'export function makeShape(kind: string, size: number): Promise<Shape[]> {'),
    ],
    "code_move": [
        ('/p/0/src/make.ts', "import { Square, Disc } from './shapes';", "import { Disc } from './shapes'; | import { Square } from './store';"),
        ('/p/0/src/shapes.ts', "export class Square implements Shape { |   name = 'square'; |   constructor(private readonly side: number) {} |   area(): number { return this.side * this.side; } | }", ''),
        ('/p/0/src/store.ts', '', "export class Square implements Shape { |   name = 'square'; |   constructor(private readonly side: number) {} |   area(): number { return this.side * this.side; } | }"),
    ],
    "code_extract_interface": [
        ('/p/0/src/shapes.ts', 'export class Disc implements Shape {', 'export interface Round { |   name: string; |   area(): unknown; | } |  | export class Disc implements Shape, Round {'),
    ],
    "code_inline_variable": [
        ('/p/0/src/make.ts', '  for (const k of [1, 2]) log(why + k); | const log = (s: string): void => { console.log(s); };', '  for (const k of [1, 2]) ((s: string): void => { console.log(s); })(why + k);'),
    ],
    "code_change_signature": [
        ('/p/0/src/make.ts', 'export function createShape(kind: string, size: number): Promise<Shape[]> {', "export function createShape(kind: string, color: string = 'red'): Promise<Shape[]> {"),
    ],
    "code_to_arrow": [
        ('/p/0/src/app.tsx', 'export function useShapes(kind: string) { return createShape(kind, 1); }', 'export const useShapes = (kind: string) => createShape(kind, 1);'),
    ],
    "code_to_async": [
        ('/p/0/src/app.tsx', 'export function useShapes(kind: string) { return createShape(kind, 1); }', 'export async function useShapes(kind: string) { return createShape(kind, 1); }'),
    ],
    "code_convert_type": [
        ('/p/0/src/shapes.ts', 'export interface Shape { area(): number; name: string }', 'export type Shape = { area(): number; name: string };'),
    ],
    "code_modify": [
        ('/p/0/src/make.ts', 'export function createShape(kind: string, size: number): Promise<Shape[]> {', 'export async function createShape(kind: string, size: number, color: string): Promise<Shape[]> {'),
    ],
    "code_encapsulate": [
        ('/p/0/src/shapes.ts', "  name = 'square';", "  private _name = 'square'; |  |   get name(): string { |     return this._name; |   } |  |   set name(value: string) { |     this._name = value; |   }"),
    ],
    "code_composition": [
        ('/p/0/src/store.ts', 'export class ShapeStore extends EventEmitter { |   private constructor(private api: ApiClient) { super(); }', 'export class ShapeStore { |   private _eventEmitter = new EventEmitter(); |  |   private constructor(private api: ApiClient) {  }'),
    ],
    "code_class_to_functions": [
        ('/p/0/src/store.ts', "@Injectable({ scope: 'app' }) | export class ShapeStore extends EventEmitter { |   private static instance: ShapeStore; |   private constructor(private api: ApiClient) { super(); } |   static getInstance(): ShapeStore { return ShapeStore.instance; } |   find(id: string) { return this.get(id); } |   save(s: Map<string, number[]>): void {} |   async delete(id: string): Promise<void> { await this.api.call(id); } |   on(e: string) {} emit(e: string) { return true } | }", 'export function getInstance(): ShapeStore { return ShapeStore.instance; } |  | export function find(id: string) { return this.get(id); } |  | export function save(s: Map<string, number[]>): void {} |  | export async function delete(id: string): Promise<void> { await this.api.call(id); } |  | export function on(e: string) {} |  | export function emit(e: string) { return true }'),
    ],
    "code_cjs_to_esm": [
        ('/p/lib/util.js', "const fs = require('fs'); | exports.read = function (p) { return fs.readFileSync(p); }; | module.exports.write = () => {};", "import fs from 'fs'; | export const read = function (p) { return fs.readFileSync(p); }; | export const write = () => {};"),
    ],
    "code_default_to_named": [
        ('/p/0/src/app.tsx', 'export default function App({ title }: Props) {', 'export function App({ title }: Props) {'),
    ],
    "code_safe_delete": [
        ('/p/lib/util.js', 'function unused() { switch (fs.x) { case 1: return 1; default: return 2; } }', ''),
    ],
}
