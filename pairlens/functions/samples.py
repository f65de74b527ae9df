"""A few own function pairs, before and after a fix, for demonstrations and tests."""

PAIRS = [
    ("merge", "function merge(target, source) {\n  for (const key in source) {\n    target[key] = source[key];\n  }\n  return target;\n}", "function merge(target, source) {\n  for (const key in source) {\n    if (key === '__proto__') continue;\n    target[key] = source[key];\n  }\n  return target;\n}"),
    ("isHost", "function isHost(value) {\n  return /^[a-z.]+$/.test(value);\n}", "function isHost(value) {\n  return /^[a-z]+(\\.[a-z]+)*$/.test(value);\n}"),
    ("render", "const render = (name, list) => {\n  const out = list.map((x) => '<li>' + x + '</li>');\n  return `<h1>${name}</h1>` + out.join('');\n};", "const render = (name, list) => {\n  const out = list.map((x) => '<li>' + escape(x) + '</li>');\n  return `<h1>${escape(name)}</h1>` + out.join('');\n};"),
    ("read", "class Store {\n  async read(path) {\n    return this.fs.readFile(this.root + '/' + path);\n  }\n}", "class Store {\n  async read(path) {\n    if (path.includes('..')) throw new Error('path');\n    return this.fs.readFile(this.root + '/' + path);\n  }\n}"),
    ("limit", "function limit(items, size) {\n  // no upper bound\n  return items.slice(0, size);\n}", "function limit(items, size) {\n  const most = Math.min(size, 100);\n  return items.slice(0, most);\n}"),
    ("parse", "export function parse(text, reviver) {\n  let at = 0;\n  function next() { at += 1; return text.charAt(at); }\n  return walk(next, reviver);\n}", "export function parse(text, reviver) {\n  let at = 0;\n  function next() { if (at > 1e6) throw new RangeError('deep'); at += 1; return text.charAt(at); }\n  return walk(next, reviver);\n}"),
]
