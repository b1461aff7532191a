"""The vocabulary of the public NISO Z39.96 standard (Journal Publishing, with XHTML tables and MathML 3), stated as values.

Models: a space is a sequence, | a choice, ? * + as usual, # text, @name the elements of a class, nothing an empty element.
Attributes: names, a type (or the values allowed, or one value in quotes), then the elements; ! marks a required attribute.
Prefixes of attributes are left out, as the reader leaves them out.
"""

from __future__ import annotations

#: Classes of elements.
CLASSES = """\
access: alt-text long-desc
address: addr-line city country fax institution institution-wrap phone postal-code state
address-line: city country fax institution institution-wrap phone postal-code state
address-link: email ext-link uri
aff-alternatives: aff aff-alternatives
alternatives-display: array chem-struct code graphic inline-graphic inline-media inline-supplementary-material media preformat private-char supplementary-material table
  textual-form
article-identifier: article-id issn issn-l isbn
article-link: inline-supplementary-material related-article related-object
article-version: article-version article-version-alternatives
back: ack app-group bio fn-group glossary ref-list
block-alternatives: boxed-text fig fig-group table-wrap table-wrap-group
block-display: address alternatives answer answer-set array block-alternatives boxed-text chem-struct-wrap code explanation fig fig-group graphic media preformat question
  question-wrap question-wrap-group supplementary-material table-wrap table-wrap-group
block-display-minus-explanation: address alternatives answer answer-set array block-alternatives boxed-text chem-struct-wrap code fig fig-group graphic media preformat
  question question-wrap question-wrap-group supplementary-material table-wrap table-wrap-group
block-math: disp-formula disp-formula-group
citation: citation-alternatives element-citation mixed-citation nlm-citation
citation-minus-alt: element-citation mixed-citation nlm-citation
conference: conf-date conf-name conf-num conf-loc conf-sponsor conf-theme conf-acronym string-conf
contrib-info: address aff aff-alternatives author-comment bio email ext-link on-behalf-of role uri xref
date: date string-date
date-parts: day era month season year
display-back-matter: attrib permissions
emphasis: bold fixed-case italic monospace overline roman sans-serif sc strike underline ruby
face-markup: bold fixed-case italic monospace overline roman sans-serif sc strike underline
fig-display: fig block-alternatives
floats-display: alternatives block-alternatives boxed-text chem-struct-wrap code fig fig-group graphic media preformat supplementary-material table-wrap table-wrap-group
funding: award-id funding-source open-access
inline-display: alternatives inline-graphic inline-media private-char
inline-display-noalt: inline-graphic inline-media private-char
inline-math: chem-struct inline-formula
inside-chem-struct-wrap: alternatives chem-struct code graphic media preformat textual-form
institution: institution institution-id
institution-wrap: institution institution-wrap
intable-para: disp-quote speech statement verse-group
investigator-name: name name-alternatives string-name
just-base-display: alternatives graphic media
just-base-display-noalt: graphic media
kwd: kwd compound-kwd nested-kwd
license: ali:free_to_read license
license-p: ali:license_ref license-p
list: def-list list
math: tex-math mml:math
name: anonymous collab collab-alternatives name name-alternatives string-name
name-alternatives: name string-name
nested-kwd: kwd compound-kwd
person-group-info: aff aff-alternatives etal role
person-name: degrees given-names prefix surname suffix
phrase: abbrev index-term index-term-range-end milestone-end milestone-start named-content styled-content
phrase-content: named-content styled-content
question-answer: answer answer-set explanation question question-wrap question-wrap-group
recipient-name: name name-alternatives institution institution-wrap string-name
references: annotation article-title chapter-title collab collab-alternatives comment conf-acronym conf-date conf-loc conf-name conf-sponsor data-title date
  date-in-citation day edition email elocation-id etal ext-link fpage gov institution institution-wrap isbn issn issn-l issue issue-id issue-part issue-title lpage month
  name name-alternatives object-id page-range part-title patent person-group pub-id publisher-loc publisher-name role season series size source std string-date
  string-name supplement trans-source trans-title uri version volume volume-id volume-series year
related-article: related-article related-object
rest-of-para: disp-quote speech statement verse-group
sec-back: fn-group glossary ref-list
simple-display: alternatives array code graphic media preformat
simple-display-noalt: array code graphic media preformat
simple-intable-display: alternatives chem-struct-wrap code disp-formula graphic media preformat
simple-link: fn target xref
std: day month pub-id source std-organization year
subsup: sub sup
linking: contrib license issue-id volume-id mixed-citation element-citation email institution uri collab ext-link related-article bio long-desc custom-meta
  article-version product self-uri conference extended-by restricted-by chem-struct graphic inline-media media inline-graphic supplementary-material resource-name
  award-group funding-source award-id award-name award-desc support-source inline-supplementary-material nlm-citation abbrev named-content pub-id related-object
"""

#: Elements and their content model, in the standard's order.
MODELS = """\
ali:free_to_read anonymous pub-date-not-available count equation-count fig-count table-count ref-count page-count word-count hr break overline-start overline-end
  underline-start underline-end milestone-start milestone-end index-term-range-end col glyph-ref:
ali:license_ref copyright-year object-id issue-id journal-id fpage lpage page-range elocation-id institution-id day month season era year contrib-id alt-text article-id
  article-version rp tex-math pub-id glyph-data: #
contrib-group: contrib+ @contrib-info*
contrib: contrib-id* @name* degrees* @contrib-info*
copyright-holder std-organization: (#|@institution-wrap|@subsup)*
copyright-statement funding-statement: (#|@address-link|@emphasis|@phrase-content|@subsup)*
license: @license-p+
license-p:
  (#|@address-link|@article-link|@block-display|@block-math|@citation|@emphasis|@funding|@inline-math|@inline-display-noalt|@list|@math|@phrase|@rest-of-para|@simple-link|@subsup|price)*
permissions: copyright-statement* copyright-year* copyright-holder* @license*
article-title trans-subtitle trans-title subtitle alt-title:
  (#|@address-link|@article-link|@emphasis|@inline-display|@inline-math|@math|@phrase|@simple-link|@subsup|break)*
aff: (#|@address|@address-link|@article-link|break|@emphasis|label|@simple-link|@subsup)*
aff-alternatives: aff+
conf-date conf-name isbn issn issn-l issue issue-part issue-sponsor issue-subtitle issue-title volume volume-id volume-series etal size city country email fax phone
  postal-code state uri degrees given-names surname prefix suffix long-desc meta-name x self-uri unstructured-kwd-group conf-acronym conf-num extended-by restricted-by rt
  resource-id award-name award-desc journal-title journal-subtitle abbrev-journal-title access-date patent time-stamp: #*
conf-loc: (#|@address)*
conf-sponsor publisher-name: (#|@institution-wrap)*
role series-title series-text gov series: (#|@emphasis|@subsup|@phrase-content)*
trans-title-group: trans-title trans-subtitle*
volume-issue-group: volume* volume-id* volume-series? issue* issue-id* issue-title* issue-title-group* issue-sponsor* issue-part?
on-behalf-of: (#|@emphasis|@subsup|@phrase-content|@institution-wrap|@simple-link)*
publisher: (publisher-name publisher-loc?)+
publisher-loc: (#|@address|@address-link)*
citation-alternatives: object-id* @citation-minus-alt+
mixed-citation: (#|@emphasis|@inline-display|@inline-math|label|@phrase|@references|@subsup)*
element-citation: (@emphasis|@inline-display|@inline-math|label|@phrase|@references|@subsup)+
address: (@address|@address-link)*
addr-line: (#|@emphasis|@inline-display|@inline-math|@phrase|@subsup|@address-line)*
institution edition version: (#|@subsup)*
institution-wrap: @institution*
supplement: (#|@emphasis|@inline-display|@inline-math|@phrase|@subsup|contrib-group|title)*
date pub-date: (((day? month?)|season)? year era?)
string-date date-in-citation: (#|@date-parts)*
collab-alternatives: collab+
collab: (#|@emphasis|@inline-display|@inline-math|@phrase|@subsup|@address|contrib-group|@contrib-info|fn)*
name-alternatives: @name-alternatives+
name: (((surname given-names?)|given-names) prefix? suffix?)
string-name: (#|@person-name)*
ext-link kwd target xref: (#|@emphasis|@phrase-content|@subsup)*
attrib meta-value bold fixed-case italic monospace roman sans-serif sc overline strike sub sup underline term-head def-head comment:
  (#|@address-link|@article-link|@emphasis|@inline-display|@inline-math|@math|@phrase|@simple-link|@subsup)*
def open-access annotation: p+
label: (#|@emphasis|@inline-display|@inline-math|@subsup)*
price: (#|@emphasis)*
title: (#|@address-link|@article-link|@emphasis|@inline-display|@inline-math|@math|@phrase|@simple-link|@subsup|break|@citation)*
related-article: (#|@emphasis|journal-id|@phrase-content|@references|@subsup)*
sig-block: (#|break|@emphasis|@just-base-display|@inline-display-noalt|@phrase-content|sig|@subsup)*
sig: (#|@emphasis|@subsup|@phrase-content|break|@inline-display-noalt|@just-base-display-noalt)*
ack: object-id* label? title? abstract* kwd-group* subj-group* p* sec* ref-list*
bio notes: sec-meta? label? title? (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* sec* @sec-back*
custom-meta-group: custom-meta+
custom-meta: meta-name meta-value
alternatives: object-id* (@alternatives-display|@math)+
textual-form: (#|@emphasis|@inline-display-noalt|@math|@phrase-content|@subsup)*
article-meta: (article-id* @article-version? article-categories? title-group (contrib-group|@aff-alternatives)* author-notes? (pub-date+|pub-date-not-available?) volume*
  volume-id* volume-series? issue* issue-id* issue-title* issue-title-group* issue-sponsor* issue-part? volume-issue-group* isbn* supplement? ((fpage lpage?
  page-range?)|elocation-id)? (@address-link|product|supplementary-material)* history? pub-history? permissions? self-uri* @related-article* abstract* trans-abstract*
  kwd-group* funding-group* support-group* conference* counts? custom-meta-group?)
article-version-alternatives: article-version+
article-categories: subj-group* series-title* series-text*
subj-group: (subject|compound-subject)+ subj-group*
subject compound-subject-part: (#|@emphasis|@inline-display|@inline-math|@phrase-content|@subsup)*
compound-subject: compound-subject-part+
author-notes: label? title? (corresp|fn|p)+
product: (#|@article-link|break|@emphasis|@inline-display|@inline-math|@phrase|price|@references|@simple-link|@subsup)*
abstract trans-abstract: object-id* label? title? p* sec*
kwd-group: label? title? @kwd+
compound-kwd: compound-kwd-part+
compound-kwd-part: (#|@emphasis|@inline-display|@inline-math|@phrase-content|@simple-link|@subsup)*
nested-kwd: @nested-kwd+ nested-kwd*
corresp: (#|@address|@address-link|@emphasis|label|@phrase-content|@subsup)*
conference: conf-date (conf-name|conf-acronym)+ conf-num? conf-loc? conf-sponsor* conf-theme?
conf-theme award-id: (#|@emphasis|@inline-display|@inline-math|@phrase|@subsup)*
string-conf: (#|@emphasis|@inline-display|@inline-math|@phrase|@subsup|@conference)*
counts: count* fig-count? table-count? equation-count? ref-count? page-count? word-count?
title-group: article-title subtitle* trans-title-group* alt-title* fn-group?
author-comment: title? p+
history: date+
event-desc: (#|@address-link|@article-identifier|@article-version|@date|pub-date|pub-date-not-available)*
event: event-desc? article-id* @article-version? (pub-date*|pub-date-not-available?) date* issn* issn-l? isbn* permissions? notes* self-uri*
pub-history: event+
issue-title-group: issue-title issue-subtitle* trans-title-group*
processing-meta: restricted-by* extended-by* custom-meta-group*
app-group: object-id* label? title? abstract* kwd-group* subj-group* (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* (app|ref-list)*
app: ((sec-meta? ((label title?)|title) (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* sec* @sec-back*) permissions?)
fn-group: label? title? fn+
glossary: object-id* label? title? (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* glossary*
block-alternatives: object-id* @block-alternatives+
array: (@access|@address-link)* (@just-base-display*|tbody) @display-back-matter*
boxed-text: object-id* sec-meta? label? caption? (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* sec* @sec-back* @display-back-matter*
chem-struct-wrap: object-id* label? caption? abstract* kwd-group* subj-group* (@access|@address-link)* @inside-chem-struct-wrap+ @display-back-matter*
chem-struct: (#|@access|@address-link|break|@emphasis|label|@list|@math|@phrase-content|@simple-display|@simple-link|@subsup)*
fig-group: object-id* label* caption* abstract* kwd-group* subj-group* (@access|@address-link)* (@fig-display|xref|@just-base-display)*
fig supplementary-material: object-id* label* caption* abstract* kwd-group* subj-group* (@access|@address-link)*
  (@block-math|chem-struct-wrap|@intable-para|table-wrap|p|@list|@simple-display|xref)* @display-back-matter*
caption: title? p*
graphic media: (@access|abstract|@address-link|caption|@display-back-matter|object-id|label|kwd-group|subj-group|xref)*
inline-media inline-supplementary-material: (#|@access|@address-link|@emphasis|@phrase-content|@subsup)*
inline-graphic: @access*
preformat: (#|@access|@address-link|@display-back-matter|@emphasis|@phrase|@subsup)*
code: (#|@address-link|@emphasis|@inline-display-noalt|@phrase|@simple-link|@subsup)*
table-wrap-group: object-id* label* caption* abstract* kwd-group* subj-group* (@access|@address-link)* (table-wrap|xref)+
table-wrap: object-id* label* caption* abstract* kwd-group* subj-group* (@access|@address-link)* (@intable-para|@list|@simple-intable-display|table|xref)*
  (table-wrap-foot|@display-back-matter)*
table-wrap-foot: title? (p|fn-group|fn|@display-back-matter)+
ruby: rb rt
rb: (#|@face-markup)*
funding-group: award-group* funding-statement* open-access*
support-group: funding-group* contributed-resource-group*
contributed-resource-group: award-group* support-description* resource-group*
support-description: p+
resource-group: (resource-name|resource-wrap)+
resource-wrap: resource-name resource-id*
resource-name: (#|@face-markup|@subsup)*
award-group: (funding-source*|support-source*) award-id* award-name? award-desc? principal-award-recipient* principal-investigator*
funding-source support-source: (#|@emphasis|@inline-display|@inline-math|@phrase|@subsup|@institution-wrap)*
principal-award-recipient: (#|contrib-id|@recipient-name)*
principal-investigator: (#|contrib-id|@investigator-name)*
journal-meta: journal-id+ journal-title-group* (contrib-group|@aff-alternatives)* issn+ issn-l? isbn* publisher? notes* self-uri*
journal-title-group: journal-title* journal-subtitle* trans-title-group* abbrev-journal-title*
fn: label? p+
def-list: label? title? term-head? def-head? def-item* def-list*
def-item: term def*
term see see-also: (#|@address-link|@article-link|@emphasis|@inline-display|@inline-math|@math|@phrase|@simple-link|@subsup|@block-math|@simple-display-noalt)*
list: object-id* label? title? list-item+
list-item: label? title? (p|@list)+
inline-formula: (#|@access|@emphasis|@inline-display|@inline-math|@math|@phrase-content|@subsup)*
disp-formula:
  (#|@access|abstract|@address-link|break|caption|@emphasis|object-id|@inline-display-noalt|@inline-math|kwd-group|subj-group|label|@phrase-content|@math|@simple-display|@subsup)*
disp-formula-group: object-id* label? caption? abstract* kwd-group* subj-group* (@access|@address-link)* @block-math*
nlm-citation: ((person-group|collab)* (article-title|trans-title)* source? patent? trans-source? year? ((month? day? time-stamp?)|season?) access-date? volume? edition?
  conf-name? conf-date? conf-loc? (issue|supplement)* publisher-loc? publisher-name? (fpage? lpage?)* page-count? series? comment* pub-id* annotation?)
p:
  (#|@address-link|@article-link|@block-display|@block-math|@citation|@emphasis|@funding|@inline-math|@inline-display-noalt|@list|@math|@phrase|@rest-of-para|@simple-link|@subsup)*
disp-quote: label? title? (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* @display-back-matter*
speech: object-id* speaker p+
speaker: (#|@person-name|@simple-link)*
statement: label? title? abstract* kwd-group* subj-group* (p|statement)+ @display-back-matter*
verse-group: label? title? subtitle? (verse-line|verse-group)+ @display-back-matter*
verse-line: (#|@emphasis|@inline-display|@inline-math|@phrase|@subsup|@simple-link)*
abbrev: (#|def)*
named-content styled-content:
  (#|@address-link|@article-link|@block-display|@block-math|@emphasis|@inline-display-noalt|@inline-math|@list|@math|@phrase|@simple-link|@subsup|@rest-of-para)*
ref-list: object-id* label? title? (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* ref* ref-list*
ref: label? (@citation|note)+
note: label? (p|product)+
chapter-title part-title source trans-source: (#|abbrev|@address-link|@emphasis|@inline-display|@inline-math|@math|@phrase-content|@simple-link|@subsup)*
data-title: (#|@address-link|@inline-display-noalt|@emphasis|@phrase-content|@subsup)*
person-group: (#|@name|@person-group-info)*
std: (#|@emphasis|@inline-display-noalt|@phrase-content|@std|@subsup)*
related-object: (#|@emphasis|@phrase-content|@references|@subsup)*
floats-group: @floats-display*
sec: (sec-meta? ((label title?)|title) (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* sec* @sec-back*)
sec-meta: object-id* contrib-group* abstract* kwd-group* subj-group* permissions?
index-term: (term (index-term|(see|see-also)*))
question: (object-id* sec-meta? label? title? subtitle* alt-title* (sec+|((@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)+ sec*)) option*
  @sec-back*)
question-wrap: object-id* question (answer|answer-set)? explanation*
question-wrap-group: object-id* label? title? subtitle* alt-title* question-preamble? question-wrap+
question-preamble: object-id* label? title? subtitle* alt-title* (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* sec*
answer option: (object-id* label? title? subtitle* alt-title* (sec+|((@block-display-minus-explanation|@block-math|@list|@math|p|@related-article|@rest-of-para)+ sec*))
  @sec-back* explanation*)
answer-set: object-id* label? title? subtitle* alt-title* (answer|p|explanation)+
explanation: (object-id* label? title? subtitle* alt-title* (sec+|((@block-display-minus-explanation|@block-math|@list|@math|p|@related-article|@rest-of-para)+ sec*))
  @sec-back*)
table: ((col*|colgroup*) ((thead? tfoot? tbody+)|tr+))
thead tfoot tbody: tr+
colgroup: col*
tr: (th|td)+
th td:
  (#|@address-link|hr|@article-link|@block-math|break|@citation|@emphasis|@inline-display-noalt|@inline-math|@intable-para|@list|@math|p|@phrase|@simple-display|@question-answer|@simple-link|@subsup)*
private-char: ((glyph-data|glyph-ref)|inline-graphic*)
article: processing-meta? front body? back? floats-group? (sub-article*|response*)
front: journal-meta article-meta notes?
body: (@block-display|@block-math|@list|@math|p|@related-article|@rest-of-para)* sec* sig-block?
back: label? title* (@back|notes|sec)*
sub-article: processing-meta? (front|front-stub) body? back? floats-group? (sub-article*|response*)
front-stub: (article-id* @article-version? article-categories? title-group? (contrib-group|@aff-alternatives)* author-notes? (pub-date*|pub-date-not-available?) volume*
  volume-id* volume-series? issue* issue-id* issue-title* issue-title-group* issue-sponsor* issue-part? volume-issue-group* isbn* supplement? ((fpage lpage?
  page-range?)|elocation-id)? (@address-link|product|supplementary-material)* history? pub-history? permissions? self-uri* @related-article* abstract* trans-abstract*
  kwd-group* funding-group* support-group* conference* counts? custom-meta-group?)
response: processing-meta? (front|front-stub) body? back? floats-group?
"""

#: Attributes, their type and the elements that have them.
ATTRIBUTES = """\
id ID: all but overline-start underline-start target
base CDATA: all
content-type CDATA: ali:free_to_read ali:license_ref contrib-group copyright-holder copyright-statement copyright-year license-p aff conf-date conf-loc conf-name
  conf-sponsor object-id isbn issn issue issue-id issue-part issue-sponsor issue-subtitle issue-title role trans-title-group trans-title volume volume-id volume-series
  volume-issue-group publisher fpage lpage page-range elocation-id address addr-line city country email fax institution institution-id phone postal-code state uri day
  month season era year string-date contrib-id name string-name degrees prefix suffix price title sig-block sig ack bio alt-text long-desc custom-meta-group x
  article-version subject compound-subject compound-subject-part series-title series-text self-uri kwd compound-kwd compound-kwd-part nested-kwd corresp conference
  conf-acronym conf-num conf-theme string-conf subtitle author-comment issue-title-group app-group app fn-group glossary array boxed-text chem-struct-wrap chem-struct
  fig-group caption graphic inline-media media inline-graphic supplementary-material table-wrap-group table-wrap fixed-case ruby rb rt resource-name resource-id
  journal-title-group journal-title journal-subtitle inline-supplementary-material inline-formula disp-formula disp-formula-group tex-math p disp-quote speech speaker
  statement verse-group verse-line abbrev milestone-start milestone-end ref-list ref note access-date annotation comment data-title date-in-citation edition gov patent
  series std std-organization source time-stamp trans-source version related-object index-term see see-also question question-wrap question-wrap-group question-preamble
  answer answer-set explanation option table thead tfoot tbody colgroup col tr th td
specific-use CDATA: all but permissions article-title aff-alternatives publisher citation-alternatives institution-wrap collab-alternatives name-alternatives given-names
  surname label meta-name meta-value alternatives article-meta article-version-alternatives article-categories subject compound-subject compound-subject-part kwd
  compound-kwd compound-kwd-part nested-kwd pub-date counts count equation-count fig-count table-count ref-count page-count word-count title-group history pub-history
  processing-meta extended-by restricted-by block-alternatives table-wrap-foot hr break rp resource-wrap award-name award-desc journal-meta journal-title-group term-head
  def-head floats-group sec-meta index-term-range-end thead tfoot tbody colgroup col tr th td glyph-data glyph-ref front back front-stub
end_date CDATA: ali:free_to_read
start_date CDATA: ali:free_to_read ali:license_ref
ali 'http://www.niso.org/schemas/ali/1.0/': ali:free_to_read ali:license_ref article
contrib-type CDATA: contrib
corresp equal-contrib deceased no|yes: contrib
rid IDREFS: contrib aff def sig-block sig bio author-notes funding-statement support-description award-group funding-source award-id support-source xref term
  named-content see see-also
xlink role title CDATA: @linking
type simple: @linking
href CDATA: contrib license issue-id volume-id mixed-citation element-citation email institution uri collab ext-link related-article bio long-desc custom-meta
  article-version product self-uri conference extended-by restricted-by chem-struct supplementary-material resource-name award-group funding-source award-id award-name
  award-desc support-source inline-supplementary-material nlm-citation abbrev named-content pub-id related-object
show embed|new|none|other|replace: @linking
actuate none|onLoad|onRequest|other: @linking
hreflang NMTOKEN: @linking
lang NMTOKEN: all but ali:free_to_read ali:license_ref contrib-group contrib copyright-year license-p permissions aff-alternatives object-id isbn issn issn-l publisher
  elocation-id citation-alternatives fax institution-wrap phone date collab-alternatives name-alternatives given-names surname title sig-block meta-name meta-value
  alternatives article-meta article-id article-version article-version-alternatives article-categories subject compound-subject compound-subject-part author-notes kwd
  compound-kwd compound-kwd-part nested-kwd pub-date-not-available counts count equation-count fig-count table-count ref-count page-count word-count title-group history
  pub-history processing-meta extended-by restricted-by block-alternatives table-wrap-foot hr break bold fixed-case italic monospace roman sans-serif sc overline strike
  sub sup underline overline-start overline-end underline-start underline-end ruby rp resource-wrap journal-meta journal-title-group term-head def-head tex-math
  access-date pub-id time-stamp floats-group sec-meta index-term-range-end table thead tfoot tbody colgroup col tr th td private-char glyph-data glyph-ref front body back
  front-stub
license-type CDATA: license
iso-8601-date CDATA: conf-date date year string-date article-version pub-date access-date date-in-citation
calendar CDATA: conf-date date year string-date pub-date access-date date-in-citation
pub-id-type CDATA: object-id issue-id volume-id
assigning-authority CDATA: object-id isbn issn issn-l issue-id journal-id role volume-id institution-id uri contrib-id ext-link custom-meta article-id article-version
  subj-group subject compound-subject self-uri kwd-group kwd compound-kwd nested-kwd unstructured-kwd-group pub-date extended-by restricted-by resource-id award-id pub-id
publication-format CDATA: isbn issn mixed-citation element-citation date pub-date nlm-citation
pub-type CDATA: issn pub-date
seq CDATA: issue volume fpage elocation-id
journal-id-type CDATA: journal-id related-article
degree-contribution CDATA: role
vocab vocab-identifier CDATA: role institution-id custom-meta article-version subj-group subject compound-subject kwd-group kwd compound-kwd nested-kwd
  unstructured-kwd-group extended-by restricted-by inline-media resource-id term named-content index-term see-also
vocab-term vocab-term-identifier CDATA: role custom-meta article-version subject compound-subject kwd compound-kwd nested-kwd extended-by restricted-by inline-media term
  named-content index-term see-also
units! CDATA: size
publication-type publisher-type CDATA: mixed-citation element-citation nlm-citation
use-type CDATA: mixed-citation element-citation
country CDATA: country funding-source support-source patent
institution-id-type CDATA: institution-id
supplement-type CDATA: supplement
date-type CDATA: date pub-date
collab-type CDATA: collab
symbol CDATA: collab fn
contrib-id-type CDATA: contrib-id
authenticated true|false: contrib-id
name-style western|eastern|islensk|given-only: name string-name
initials CDATA: given-names surname
ext-link-type CDATA: ext-link related-article related-object
alt CDATA: label xref abbrev named-content styled-content
currency CDATA: price
related-article-type! CDATA: related-article
vol page issue elocation-id journal-id CDATA: related-article
notes-type CDATA: notes
space 'preserve': x preformat code glyph-data
pub-id-type
  accession|archive|ark|art-access-id|arxiv|coden|doaj|doi|handle|index|isbn|manuscript|medline|mr|other|pii|pmcid|pmid|publisher-id|sici|std-designation|zbl|custom:
  article-id pub-id
custom-type CDATA: article-id fn xref person-group pub-id
article-version-type CDATA: article-version
designator CDATA: article-version extended-by restricted-by edition version
subj-group-type CDATA: subj-group
product-type CDATA: product
abstract-type CDATA: abstract trans-abstract
kwd-group-type CDATA: kwd-group unstructured-kwd-group
count-type! CDATA: count
count! NMTOKEN: count equation-count fig-count table-count ref-count page-count word-count
alt-title-type CDATA: alt-title
event-type CDATA: event
tagset-family jats|bits|sts: processing-meta
base-tagset publishing|archiving|authoring: processing-meta
table-model xhtml|oasis|both|none: processing-meta
math-representation NMTOKENS: processing-meta
mathml-version 2.0|3.0: processing-meta
orientation portrait|landscape: array boxed-text chem-struct-wrap fig-group fig graphic media preformat code supplementary-material table-wrap-group table-wrap
position anchor|background|float|margin: boxed-text chem-struct-wrap fig-group fig graphic media preformat code supplementary-material table-wrap-group table-wrap
fig-type CDATA: fig
style CDATA: caption verse-group verse-line styled-content table thead tfoot tbody colgroup col tr th td
mime-subtype mimetype CDATA: graphic inline-media media inline-graphic supplementary-material inline-supplementary-material
href! CDATA: graphic inline-media media inline-graphic
baseline-shift CDATA: inline-graphic
preformat-type CDATA: preformat
code-type code-version language language-version platforms CDATA: code
executable yes|no: code
toggle yes|no: bold italic monospace roman sans-serif sc overline strike underline styled-content
arrange stack|stagger: sub sup
underline-style CDATA: underline
id! ID: overline-start underline-start target
rid! IDREF: overline-end underline-end index-term-range-end
resource-type CDATA: contributed-resource-group
resource-id-type CDATA: resource-id
award-type CDATA: award-group award-id
source-type CDATA: funding-source related-object
award-id-type CDATA: award-id
support-type CDATA: support-source
abbrev-type CDATA: abbrev-journal-title
fn-type
  abbr|coi-statement|com|con|conflict|corresp|current-aff|deceased|edited-by|equal|financial-disclosure|on-leave|participating-researchers|presented-at|presented-by|present-address|previously-at|study-group-members|supplementary-material|supported-by|other|custom:
  fn
target-type CDATA: target
ref-type
  aff|app|author-notes|award|bibr|bio|boxed-text|chem|collab|contrib|corresp|disp-formula|fig|fn|kwd|list|plate|scheme|sec|statement|supplementary-material|table|table-fn|other|custom:
  xref
list-type prefix-word list-content CDATA: def-list list
continued-from IDREF: def-list list
term-status term-type CDATA: term
notation LaTeX|tex|TEX|TeX: tex-math
version CDATA: tex-math
style-detail style-type CDATA: verse-group verse-line styled-content
indent-level CDATA: verse-line
rid IDREF: milestone-start milestone-end
rationale CDATA: milestone-start milestone-end
content-type! CDATA: named-content
person-group-type allauthors|assignee|author|compiler|curator|director|editor|guest-editor|illustrator|inventor|research-assistant|translator|transed|custom: person-group
link-type source-id source-id-type document-id document-id-type document-type object-id object-id-type object-type CDATA: related-object
sec-type CDATA: sec
index-type NMTOKENS: index-term
question-response-type essay|fill-in-the-blank|multi-select|multiple-choice|short-answer|true-false: question
audience CDATA: question-wrap question-wrap-group
pointer-to-question! IDREFS: answer
pointer-to-explained! IDREFS: explanation
correct yes|no: option
summary border cellspacing cellpadding CDATA: table
width CDATA: table colgroup col
frame void|above|below|hsides|lhs|rhs|vsides|box|border: table
rules none|groups|rows|cols|all: table
align left|center|right|justify|char: thead tfoot tbody colgroup col tr th td
char charoff CDATA: thead tfoot tbody colgroup col tr th td
valign top|middle|bottom|baseline: thead tfoot tbody colgroup col tr th td
span CDATA: colgroup col
abbr axis rowspan colspan CDATA: th td
headers IDREFS: th td
scope row|col|rowgroup|colgroup: th td
description name CDATA: private-char
fontchar fontname resolution x-size y-size CDATA: glyph-data
format NMTOKEN: glyph-data
glyph-data IDREF: glyph-ref
article-type CDATA: article sub-article
dtd-version 3.0|0.4|1.0|1.1d1|1.1d2|1.1d3|1.1|1.2d1|1.2d2|1.2|1.3d1|1.3d2|1.3: article
xlink 'http://www.w3.org/1999/xlink': article
mml 'http://www.w3.org/1998/Math/MathML': article
xsi 'http://www.w3.org/2001/XMLSchema-instance': article
noNamespaceSchemaLocation CDATA: article
response-type CDATA: response
"""

#: Values that only some versions allow, as (element, attribute).
VERSION_VALUES = {"1.4": {("article", "dtd-version"): "1.4d1 1.4"}}

#: MathML, its names without the prefix; jats: marks the standard's own elements.
MATH_CLASSES = """\
function: inverse ident domain codomain image ln log moment compose quotient divide minus power rem root factorial abs conjugate arg real imaginary floor ceiling exp max min
  plus times gcd lcm and or xor not implies equivalent forall exists eq gt lt geq leq neq approx factorof tendsto int diff partialdiff divergence grad curl laplacian union
  intersect cartesianproduct in notin notsubset notprsubset setdiff subset prsubset card sum product limit sin cos tan sec csc cot sinh cosh tanh sech csch coth arcsin arccos
  arctan arccosh arccot arccoth arccsc arccsch arcsec arcsech arcsinh arctanh mean sdev variance median mode determinant transpose selector vectorproduct scalarproduct
  outerproduct integers reals rationals naturalnumbers complexes primes emptyset exponentiale imaginaryi notanumber true false pi eulergamma infinity
content: piecewise reln fn declare interval lambda set list vector matrix matrixrow semantics cn ci csymbol apply bind share cerror cbytes cs @function
shown: mi mn mo mtext mspace ms maligngroup malignmark mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover
  mmultiscripts mtable mstack mlongdiv maction
any: @content @shown
stacked: @any mscarries msline msrow msgroup
"""
MATH_MODELS = """\
share sep @function mspace mglyph msline none mprescripts malignmark maligngroup:
cn: (#|mglyph|sep|@shown)*
ci csymbol: (#|mglyph|@shown)*
apply bind: @content bvar* (domainofapplication|condition|(lowlimit uplimit?)|degree|momentabout|logbase)* @content*
cerror: csymbol @content*
cbytes cs annotation: #
bvar: (degree (ci|semantics))|((ci|semantics) degree?)
domainofapplication condition uplimit lowlimit degree momentabout logbase otherwise fn: @content
piecewise: (piece|otherwise)*
piece interval: @content @content
reln: @content*
declare: @content+
lambda: bvar* (domainofapplication|condition|(lowlimit uplimit?))* @content
set list: bvar* (domainofapplication|condition|(lowlimit uplimit?))* @content*
vector matrix matrixrow: bvar* (domainofapplication|condition|(lowlimit uplimit?))* @content*
mi mn mo mtext ms: (#|mglyph|malignmark)*
mrow mfenced math msqrt mstyle merror mpadded mphantom menclose mtd: @any*
mfrac mroot msub msup munder mover: @any @any
msubsup munderover: @any @any @any
mmultiscripts: @any ((@any|none) (@any|none))* (mprescripts ((@any|none) (@any|none))*)?
mtable: (mtr|mlabeledtr)*
mlabeledtr: mtd+
mtr: mtd*
mstack msgroup: @stacked*
mlongdiv: @stacked @stacked @stacked+
msrow mscarry: (@any|none)*
mscarries: (@any|none|mscarry)*
maction: @any+
annotation-xml: jats:p+
semantics: @any (annotation|annotation-xml)*
"""
MATH_ATTRIBUTES = """\
mml 'http://www.w3.org/1998/Math/MathML': all but declare
href lang xref class style other CDATA: all but declare
type CDATA: all
space default|preserve: all but declare
id ID: all but declare
src CDATA: share mglyph annotation annotation-xml
encoding definitionURL CDATA: all but apply bind share cerror mi mn mo mtext mspace ms mglyph msline none mprescripts malignmark maligngroup mrow mfrac msqrt mroot mstyle
  merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mlabeledtr mtr mtd mstack mlongdiv msgroup msrow mscarries
  mscarry maction math
base CDATA: cn
cd CDATA: csymbol annotation annotation-xml semantics
scope nargs CDATA: declare
occurrence prefix|infix|function-model: declare
closure CDATA: interval
order numeric|lexicographic: list
mathcolor mathbackground CDATA: mi mn mo mtext mspace ms mglyph msline none mprescripts malignmark maligngroup mrow mfrac msqrt mroot mstyle merror mpadded mphantom
  mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mlabeledtr mtr mtd mstack mlongdiv msgroup msrow mscarries mscarry maction math
mathvariant
  normal|bold|italic|bold-italic|double-struck|bold-fraktur|script|bold-script|fraktur|sans-serif|bold-sans-serif|sans-serif-italic|sans-serif-bold-italic|monospace|initial|tailed|looped|stretched:
  mi mn mo mtext mspace ms mglyph mstyle math
mathsize CDATA: mi mn mo mtext mspace ms mglyph mstyle math
dir ltr|rtl: mi mn mo mtext mspace ms mrow mstyle math
fontfamily fontsize color background CDATA: mi mn mo mtext mspace ms mglyph mstyle
fontweight normal|bold: mi mn mo mtext mspace ms mglyph mstyle
fontstyle normal|italic: mi mn mo mtext mspace ms mglyph mstyle
form prefix|infix|postfix: mo mstyle math
fence separator stretchy symmetric largeop movablelimits true|false: mo mstyle math
lspace CDATA: mo mstyle mpadded math
rspace maxsize minsize lineleading linebreakmultchar indentshift indenttarget indentshiftfirst indentshiftlast CDATA: mo mstyle math
accent true|false: mo mstyle mover munderover math
linebreak auto|newline|nobreak|goodbreak|badbreak: mo mstyle math
linebreakstyle before|after|duplicate|infixlinebreakstyle: mo mstyle math
indentalign left|center|right|auto|id: mo mstyle math
indentalignfirst indentalignlast left|center|right|auto|id|indentalign: mo mstyle math
width CDATA: mspace mglyph mstyle mpadded mtable math
height CDATA: mspace mglyph mstyle mpadded math
depth CDATA: mspace mstyle mpadded math
linebreak auto|newline|nobreak|goodbreak|badbreak|indentingnewline: mspace
lquote rquote CDATA: ms mstyle math
valign CDATA: mglyph mstyle math
alt index CDATA: mglyph
position CDATA: msline mstyle mlongdiv msgroup msrow mscarries math
length leftoverhang rightoverhang mslinethickness CDATA: msline mstyle math
edge left|right: malignmark mstyle math
groupalign left|center|right|decimalpoint: maligngroup
linethickness CDATA: mfrac mstyle math
numalign denomalign left|center|right: mfrac mstyle math
bevelled true|false: mfrac mstyle math
scriptlevel scriptminsize decimalpoint CDATA: mstyle math
displaystyle equalcolumns equalrows true|false: mstyle mtable math
scriptsizemultiplier CDATA: mstyle mscarries math
infixlinebreakstyle before|after|duplicate: mstyle math
accentunder true|false: mstyle munder munderover math
align left|right|center: mstyle munder mover munderover math
alignmentscope columnlines columnspacing columnwidth framespacing minlabelspacing rowalign rowlines rowspacing CDATA: mstyle mtable math
charalign left|center|right: mstyle mstack math
charspacing CDATA: mstyle mstack math
close open separators CDATA: mstyle mfenced math
columnalign CDATA: mstyle mtable mlabeledtr mtr math
columnspan rowspan CDATA: mstyle mtd math
crossout CDATA: mstyle mscarries mscarry math
frame none|solid|dashed: mstyle mtable math
groupalign CDATA: mstyle mtable mlabeledtr mtr mtd math
location w|nw|n|ne|e|se|s|sw: mstyle mscarries mscarry math
longdivstyle CDATA: mstyle mlongdiv math
notation CDATA: mstyle menclose math
selection CDATA: mstyle maction math
shift CDATA: mstyle mlongdiv msgroup math
side left|right|leftoverlap|rightoverlap: mstyle mtable math
stackalign left|center|right|decimalpoint: mstyle mstack math
subscriptshift CDATA: mstyle msub msubsup mmultiscripts math
superscriptshift CDATA: mstyle msup msubsup mmultiscripts math
veryverythinmathspace verythinmathspace thinmathspace mediummathspace thickmathspace verythickmathspace veryverythickmathspace CDATA: mstyle
voffset CDATA: mpadded
align CDATA: mtable mstack
rowalign top|bottom|center|baseline|axis: mlabeledtr mtr mtd
columnalign left|center|right: mtd
actiontype CDATA: maction
display block|inline: math
maxwidth altimg altimg-width altimg-height altimg-valign alttext cdgroup mode macros CDATA: math
overflow linebreak|scroll|elide|truncate|scale: math
name CDATA: annotation annotation-xml semantics
"""
