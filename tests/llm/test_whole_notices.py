"""Whole license notices, wherever they stand in a text, and their paragraphs alone."""

from pactum.llm import license_scan

FILLER = [f"filler{k % 97}" for k in range(900)]


def _labels(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in license_scan.scan(df, **how).collect()}


def _at(offset, words):
    return " ".join([*FILLER[:offset], *words, *FILLER[offset : offset + 300]])


def test_long_templates_at_every_offset(spark):
    notices = [(f"n{n}", " ".join(f"l{n}word{k}" for k in range(n))) for n in (34, 54, 64, 90, 170)]
    texts, want = [], []
    for label, notice in notices:
        for offset in range(2 * len(notice.split())):
            texts.append(_at(offset, notice.split()))
            want.append({label})
    assert _labels(spark, texts, notices=notices) == dict(enumerate(want))


def test_listed_notices_at_every_offset(spark):
    longest = {}
    for label, notice in license_scan.NOTICES:
        longest[label] = max(longest.get(label, ""), notice, key=len)
    assert max(len(t.split()) for t in longest.values()) > 160
    got = _labels(spark, [_at(offset, longest["mit"].split()) for offset in range(340)])
    assert all("mit" in labels for labels in got.values())


def test_paragraphs_without_their_opening(spark):
    warranty = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    clauses = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    got = _labels(spark, [_at(50, warranty.split()), _at(70, clauses.split()), _at(0, [])])
    assert "mit" in got[0] and got[1] == {"bsd"} and got[2] == set()
